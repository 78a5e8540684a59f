"""The registered queries on the test tables: their columns, their rows, and SQL where there is some."""

import os

import duckdb
import pytest

from tessera.llm import registry

SF = os.environ.get("TESSERA_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

# What each query returns at least, and the table that has as many rows.
CONTRACTS = {
    "op1_toxicity": (["doc_id", "held_out", "score", "predicted"], "documents"),
    "op2_exact_dedup": (["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "documents"),
    "op3_secret_scan": (["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], "documents"),
    "op4_tool_calls": (["conv_id", "call_id", "status", "json"], None),
    "linked_tool_calls": (["conv_id", "call_id", "level", "errors", "json"], None),
    "op5_ann": (["query_id", "rank", "vec_id", "score"], None),
    "op6_license_scan": (["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"], "documents"),
    "op7_language_id": (["doc_id", "held_out", "lang_pred", "score"], "documents"),
    "secret_scan_base": (["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"], "documents"),
    "license_scan_base": (["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"], "documents"),
    "bpe_round_trip": (["doc_id", "decoded_sha256"], "documents"),
    "op8_jaccard_join": (["doc_id", "n_shingles", "component_id"], "documents"),
    "op9_mixing": (["doc_id", "tokens", "rate", "copies"], "documents"),
    "op10_byte_bpe": (["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "documents"),
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "conversations", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def results(spark):
    return {k: f(spark, SF).cache() for k, f in registry.queries().items()}


def test_all_are_registered():
    assert set(registry.queries()) == set(CONTRACTS)


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract(results, duck, name):
    columns, table = CONTRACTS[name]
    df = results[name]
    assert df.columns[: len(columns)] == columns or set(columns) <= set(df.columns)
    if table:
        assert sorted(r.doc_id for r in df.select("doc_id").collect()) == sorted(r[0] for r in duck.execute(f"SELECT doc_id FROM {table}").fetchall())


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_same_in_sql(results, duck, name):
    got = results[name]
    result = duck.execute(registry.oracle_sql()[name])
    names, want = [d[0] for d in result.description], result.fetchall()
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(map(tuple, want), key=key)


def test_languages_of_held_out_rows(results, duck):
    truth = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    held = [r for r in results["op7_language_id"].collect() if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_toxicity_orders_held_out_rows(results, duck):
    truth = dict(duck.execute("SELECT doc_id, toxic FROM labels").fetchall())
    held = [(r.score, truth[r.doc_id]) for r in results["op1_toxicity"].collect() if r.held_out and r.doc_id in truth]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert not pos or sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) >= 0.5 * len(pos) * len(neg)


LARGER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")
def test_toxicity_on_a_larger_table(spark):
    from tessera.llm.toxicity import op1_toxicity

    truth = dict(duckdb.execute(f"SELECT doc_id, max(toxic) FROM '{LARGER}/labels.parquet' GROUP BY doc_id").fetchall())
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in op1_toxicity(spark, LARGER).collect() if r.held_out and r.doc_id in truth]
    pos, neg = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert len(pos) >= 30 and sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) >= 0.95 * len(pos) * len(neg)
    assert sum(p == y for _, p, y in held) >= 0.95 * len(held)
