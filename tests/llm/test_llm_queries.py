"""The registered queries' columns and the pipeline's stages."""
from __future__ import annotations

import os

import corpus_pipeline
import duckdb
import pytest
from netweft.llm import byte_bpe, decontamination, minhash, pii, quality, registry
from pyspark.sql import functions as F

COLUMNS = {
    "op1_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
    "op2_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "rgb"],
    "op3_repeats": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeated"],
    "op4_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op5_quality": ["doc_id", "quality", "kept"],
    "op6_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op7_decontamination": ["doc_id", "contaminated", "item_ids", "coverage"],
    "op8_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_language": ["doc_id", "page_id", "lang", "probability", "kept"],
    "op10_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_iban", "n_ssn", "n_secret", "private", "score"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    tables = {"op4_warc": ["pages"], "op9_language": ["documents", "pages"]}.get(name, ["documents"])
    assert df.columns == COLUMNS[name]
    assert len(df.collect()) == sum(spark.read.parquet(f"{data}/{t}.parquet").count() for t in tables)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet{'/*' if os.path.isdir(f'{data}/{t}.parquet') else ''}'")
    found = con.execute(registry.ORACLES[name])
    names, kinds = [c[0] for c in found.description], [str(c[1]) for c in found.description]
    df = registry.QUERIES[name](spark, data)
    assert {c: {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}[k] for c, k in df.dtypes} == dict(zip(names, kinds))
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*names).collect())


def test_pipeline_of_awkward_rows(spark, data, tmp_path):
    """Nulls, empty and blank texts, a repeated row, equal texts, a text without spaces, columns of other names; and no rows at all."""
    prose = next(r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").orderBy(F.length("text").desc()).collect())
    rows = [(1, None), (2, ""), (3, " \n "), (4, prose), (4, prose), (9, prose), (None, prose + " and more"), (5, "x" * 300_000), (6, "mail a@b.org " + prose[::-1])]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for k, df in enumerate((docs, docs.where("false"))):
        for name in ("documents", "benchmark"):
            (df if name == "documents" else spark.read.parquet(f"{data}/benchmark.parquet")).write.parquet(f"{tmp_path}/{k}/{name}.parquet")
        got = registry.QUERIES["pipeline"](spark, f"{tmp_path}/{k}")
        assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
        kept = [r["doc_id"] for r in got.collect()]
        assert k or 4 in kept and len(kept) == len(set(kept)) and not {1, 2, 3, 9} & set(kept)
        assert not k or not kept


def test_pipeline_is_its_stages_by_hand(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "byte_bpe"]

    good = stages["quality"](spark, docs, data).cache()
    kept = {r["doc_id"] for r in quality.classify(docs).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept

    distinct = stages["near_dedup"](spark, good, data).cache()
    classes = minhash.near_duplicates(good, words=5).collect()
    assert {r["doc_id"] for r in distinct.collect()} == {r["component_id"] for r in classes}

    unseen = stages["decontamination"](spark, distinct, data).cache()
    leaks = {r["doc_id"] for r in decontamination.contaminated(docs, spark.read.parquet(f"{data}/benchmark.parquet")).where("contaminated").collect()}
    assert {r["doc_id"] for r in unseen.collect()} == {r["doc_id"] for r in distinct.collect()} - leaks

    private = stages["pii"](spark, unseen, data).cache()
    for r in private.collect():
        want = pii.redacted(rows[r["doc_id"]]["text"])
        assert (r["text"], r["n_chars"], r["source"], r["lang"]) == (want, len(want), rows[r["doc_id"]]["source"], rows[r["doc_id"]]["lang"])
    for df in (good, distinct, unseen, private):
        assert df.columns == docs.columns

    e = byte_bpe.encoder(byte_bpe.default_ranks(), byte_bpe.public_tokenizers.PATTERN)
    last = {r["doc_id"]: bytes(r["ids"]) for r in stages["byte_bpe"](spark, private, data).collect()}
    assert last == {r["doc_id"]: e.encode(r["text"]) for r in private.collect()}
    assert {r["doc_id"] for r in registry.QUERIES["pipeline"](spark, data).collect()} == set(last)
