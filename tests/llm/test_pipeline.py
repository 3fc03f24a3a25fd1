"""Each stage against a brute-force version on a small corpus."""

import os

import pytest

pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from lumenark.llm.bpe import load_ranks  # noqa: E402
from lumenark.llm.queries import vocabulary  # noqa: E402
from lumenark.llm.shared import written  # noqa: E402

from . import test_decontaminate, test_near_dedup, test_pii  # noqa: E402


def test_stages(spark, sf_dir, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (df.where("doc_id < 350") if "doc_id" in df.columns else df).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, outputs = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, str(tmp_path)), name)
        outputs[name] = before, docs
        if name != "byte_bpe":
            assert docs.columns == columns and docs.dtypes == before.dtypes
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    before, after = outputs["quality_rules"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(str(tmp_path / "labels.parquet")).collect()}
    kept = {r.doc_id for r in after.collect()}
    assert not any(labels.get(d) == 0 for d in kept) and after.where(F.length("text") != F.col("n_chars")).count() == 0
    before, after = outputs["near_dedup"]
    want = test_near_dedup.brute(rows(before), 5, 80)
    assert {d for d, _ in rows(after)} == {d for d, (_, c) in want.items() if c == d}
    before, after = outputs["decontaminate"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(str(tmp_path / "benchmark.parquet")).collect()]
    assert sorted(d for d, _ in rows(after)) == sorted(r[0] for r in test_decontaminate.brute(rows(before), bench) if not r[5])
    before, after = outputs["pii"]
    old, new = dict(rows(before)), dict(rows(after))
    assert old.keys() == new.keys()
    for d, text in old.items():
        assert not any(test_pii.base_spans(new[d]).values())
        if not any(test_pii.base_spans(text).values()):
            assert new[d] == text or "[" in new[d]
    before, after = outputs["byte_bpe"]
    ranks = load_ranks(vocabulary())
    import public_tokenizers

    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = dict(rows(before))
    assert all(list(r.ids) == reference.encode_ordinary(text[r.doc_id]) for r in after.collect()) and after.count() == before.count()
    from lumenark.llm.shared import shared_folder

    before = {p for p in os.listdir(shared_folder(spark)) if p.startswith("lumenark-")}
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, run.collect())) == sorted(map(str, after.collect()))
    left = {p for p in os.listdir(shared_folder(spark)) if p.startswith("lumenark-")} - before
    assert sorted(p.split("-")[2] for p in left) == sorted(name for name, _ in corpus_pipeline.STAGES)


def odd_documents(spark):
    """Null ids, texts and other columns, empty and long texts, repeated rows, ties and columns of clashing names."""
    prose = lambda k: "\n".join(" ".join(f"word{k}x{i}y{j}" for j in range(12)) + "." for i in range(8))
    long = "\n".join(" ".join(f"long{i}x{j}" for j in range(12)) + "." for i in range(8000))
    rows = [(1, prose(1), "en", "s"), (1, prose(1), "en", "s"), (1, prose(2), None, None), (2, prose(1), "en", "s"), (None, prose(3), "en", "s"), (None, prose(3), "en", "s"), (None, None, None, None),
            (3, None, "en", "s"), (4, "", "en", "s"), (5, long, "en", "s"), (6, prose(4) + "\nmail a@b.org now and then to somebody.", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.selectExpr("*", "1 as id", "2 as hash", "'r' as row", "3 as kept", "4 as candidates", "5 as hit_id", "6 as component_id", "array(7) as bands"), prose, long


def test_stages_on_odd_rows(spark, tmp_path):
    df, prose, long = odd_documents(spark)
    spark.createDataFrame([(1, "some ten words that no document has at all here"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    mail = prose(4) + "\nmail a@b.org now and then to somebody."
    every = {(1, prose(1)): 2, (1, prose(2)): 1, (2, prose(1)): 1, (None, prose(3)): 2, (None, None): 1, (3, None): 1, (4, ""): 1, (5, long): 1, (6, mail): 1}
    empty = [(None, None), (3, None), (4, "")]
    want = {
        "quality_rules": {k: n for k, n in every.items() if k not in empty},
        "near_dedup": {k: 1 if k[0] else n for k, n in every.items() if k != (2, prose(1))},
        "decontaminate": every,
        "pii": {(k if k[0] != 6 else (6, mail.replace("a@b.org", "[EMAIL]"))): n for k, n in every.items()},
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        if name == "byte_bpe":
            assert out.count() == df.count()
            continue
        assert out.columns == df.columns and out.dtypes == df.dtypes, name
        got = {}
        for r in out.collect():
            got[r.doc_id, r.text] = got.get((r.doc_id, r.text), 0) + 1
            assert r.n_chars == (len(r.text) if r.text is not None else None) and r.row == "r" and r.bands == [7], name
        assert got == want[name], name
        assert stage(spark, df.where("false"), str(tmp_path)).count() == 0, name
