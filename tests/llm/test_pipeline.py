from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from stratavox.llm import mixing, queries
from stratavox.llm.common import materialise

from . import corpus
from .test_operators import base_spans


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = corpus.frame(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (docs, made := materialise(stage(spark, docs, ""), name))
        docs = made
    return out


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_copies", "secret_scan", "source_mixing", "encoding"]
    assert all(stages[n][0].columns == stages[n][1].columns for n in names[:-1])


def test_languages_keep_clean_documents(stages):
    before, after = stages["language_id"]
    kept = set(ids(after))
    assert set(range(40)) <= kept and not kept & {100, 101, 102, 104}


def test_one_of_each_group_stays(stages):
    before, after = stages["near_copies"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want = {i for i, _, c in corpus.components(rows, 80, 5) if i == c}
    assert Counter(ids(after)) == Counter(want)


def test_texts_under_one_id_are_documents(spark):
    long_ = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    texts = [(7, long_[0]), (7, long_[1]), (7, long_[0]), (3, long_[0] + " end"), (None, long_[2]), (None, long_[2]), (None, None), (9, ""), (9, "")]
    rows = [(i, t, None, None, None, "s", "w", "i", "p", "q") for i, t in texts]
    got = corpus_pipeline.drop_near_copies(spark, corpus.frame(spark, rows), "").select("doc_id", "text").collect()
    assert Counter(map(tuple, got)) == Counter([(3, long_[0] + " end"), (7, long_[1]), (None, long_[2]), (None, None), (9, ""), (9, "")])


def test_secrets_are_masked(stages):
    before, after = stages["secret_scan"]
    old, new = ({r["doc_id"]: r for r in df.collect()} for df in (before, after))
    assert old.keys() == new.keys()
    changed = {i for i in old if old[i]["text"] != new[i]["text"]}
    # The brute-force spans say which; 20,000 letters a are a hex run by the pattern.
    assert changed == {i for i in old if base_spans(old[i]["text"])} and {110, 111} <= changed
    assert all("[SECRET]" in new[i]["text"] and new[i]["n_chars"] == len(new[i]["text"]) for i in changed)


def test_mix_is_taken(stages):
    before, after = stages["source_mixing"]
    want = Counter({r["doc_id"]: r["repeats"] for r in mixing.mix_sizes(before).collect() if r["repeats"]})
    assert Counter(ids(after)) == want


def test_ids(stages):
    before, after = stages["encoding"]
    p = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.TOKENIZER)
    text = {r["doc_id"]: r["text"] for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count()
    assert all(r["ids"] == [*p.encode(text[r["doc_id"]]), 2] and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_empty_tables(spark):
    docs = corpus.frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.isEmpty()


CONTRACT = {
    "op1": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op2": {"doc_id", "held_out", "score", "predicted"},
    "op3": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op4": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op5": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op6": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op7": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op8": {"doc_id", "n_shingles", "component_id"},
    "op9": {"doc_id", "held_out", "lang_pred", "score"},
    "op10": {"doc_id", "size", "source_size", "target", "taken"},
    "op11": {"doc_id", "held_out", "score", "predicted"},
    "op12": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
    "op13": {"vec_id", "code", "error", "label_error", "codebooks_sha256"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_contracts(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    assert CONTRACT[name.split("_")[0]] <= set(got.columns)
    table = "embeddings" if name.startswith("op13_") else "documents"
    assert got.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_queries_equal_their_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for name, sql in queries.ORACLE_SQL.items():
        table = "embeddings" if name.startswith("op13_") else "documents"
        con.execute(f"create or replace view {table} as select * from '{sf_dir}/{table}.parquet'")
        got = queries.QUERIES[name](spark, sf_dir)
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(map(tuple, want.fetchall()))
