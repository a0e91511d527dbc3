"""The registered queries against their SQL, and the pipeline's stages against brute force on the same rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from loomspark.llm import queries, toxicity
from tokenizers import Tokenizer

from ..oracle import of_spark, of_sql
from .conftest import ITEM, SCHEMA, corpus, words
from .test_operators import WORD, WORD_BPE, brute_components, brute_removals, lower


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert of_spark(queries.QUERIES[name](spark, sf_dir)) == of_sql(queries.ORACLES[name], sf_dir)


def test_pipeline(spark, sf_dir):
    docs = corpus_pipeline._table(spark, sf_dir, "documents")
    labels = corpus_pipeline._table(spark, sf_dir, "labels")
    rejected = {r["doc_id"] for r in toxicity.scores(docs, labels).collect() if r["toxic"]}
    rows = sorted((r for r in docs.collect() if r["doc_id"] not in rejected), key=lambda r: r["doc_id"])
    kept = brute_components(rows)
    rows = [r for i, r in enumerate(rows) if kept[i][1] == r["doc_id"]]
    left = {r["doc_id"]: w[4].decode(errors="ignore") for r, w in zip(rows, brute_removals(rows), strict=True)}
    frame, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf_dir).persist()
        seen.append(name)
        if name != "bpe":
            assert frame.columns == docs.columns
        if name == "toxicity":
            assert {r["doc_id"] for r in frame.collect()} == {r["doc_id"] for r in docs.collect()} - rejected
        if name == "near_duplicates":
            assert {r["doc_id"] for r in frame.collect()} == {r["doc_id"] for r in rows}
        if name == "substring_dedup":
            assert {r["doc_id"]: r["text"] for r in frame.collect()} == left and all(r["n_chars"] == len(r["text"]) for r in frame.collect())
    assert seen == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "bpe"]
    items = [r["text"] for r in corpus_pipeline._table(spark, sf_dir, "benchmark").collect()]
    left = {i: t for i, t in left.items() if not contaminated(t, items)}
    got = Counter((r["doc_id"], r["n_tokens"], tuple(r["token_ids"]), r["decoded_sha256"]) for r in frame.collect())
    assert got == Counter((i, *encoded(t)) for i, t in left.items()) and left


def encoded(text: str | None, library=Tokenizer.from_file(WORD_BPE)) -> tuple:
    """n_tokens, token_ids, decoded_sha256 of a text by the library."""
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), tuple(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def contaminated(text: str | None, items: list[str | None]) -> bool:
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    have = split(text)
    for ws in map(split, items):
        n = min(10, len(ws))
        wanted = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if ws else set()
        if any(tuple(have[k : k + n]) in wanted for k in range(len(have) - n + 1)):
            return True
    return False


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, equal ids and columns with clashing names, stage by stage against brute force."""
    rnd = random.Random(8)
    rows = corpus() + [(200 + i, f"{words(rnd, 30)} zonk {words(rnd, 9)}" if i % 2 else words(rnd, 40), "en", None, None, 7, None, 1, "z") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    tables = {
        "documents": docs.repartition(3),
        "labels": spark.createDataFrame([(200 + i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, ITEM), (2, None), (None, "x")], "item_id long, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    frame, before = spark.read.parquet(str(tmp_path / "documents.parquet")), rows
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path)).persist()
        got = Counter(tuple((r.asDict()[c] if c != "token_ids" else tuple(r[c])) for c in frame.columns) for r in frame.collect())
        if name == "toxicity":
            verdicts = toxicity.scores(docs, tables["labels"]).collect()
            assert not got - Counter(before) and any(r["toxic"] for r in verdicts)
            assert Counter(r[0] for r in got.elements()) == Counter(r["doc_id"] for r in verdicts if not r["toxic"])
        if name == "near_duplicates":
            known = brute_components([{"doc_id": r[0], "text": r[1]} for r in before])
            groups = {known[i][2] for i, r in enumerate(before) if known[i][0]}
            assert not got - Counter(before) and sum(bool(WORD.search(r[1] or "")) for r in got.elements()) == len(groups)
            assert sum(not WORD.search(r[1] or "") for r in got.elements()) == sum(not known[i][0] for i in range(len(before)))
        if name == "substring_dedup":
            cut = brute_removals([{"doc_id": r[0], "text": r[1]} for r in before])
            texts = [None if r[1] is None else w[4].decode(errors="ignore") for r, w in zip(before, cut, strict=True)]
            assert got == Counter((r[0], t, *r[2:4], None if t is None else len(t), *r[5:]) for r, t in zip(before, texts, strict=True))
        if name == "decontamination":
            assert got == Counter(r for r in before if not contaminated(r[1], [ITEM])) and sum(got.values()) < len(before)
        if name == "bpe":
            assert got == Counter((r[0], *encoded(r[1])) for r in before)
        else:
            assert frame.columns == docs.columns
        before = list(got.elements())


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "decoded_sha256"] and out.count() == 0
