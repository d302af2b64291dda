"""Queries against their SQL, and the shape of the results that have contracts."""

import pytest
from tests.check_oracles import compare, connect
from trendloom.llm.oracles import ORACLES
from trendloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir).sql(ORACLES[name])) == []


@pytest.mark.parametrize(
    "number, columns",
    [
        (1, "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string"),
        (2, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"),
        (3, "doc_id bigint, held_out boolean, lang_pred string, score double"),
        (5, "doc_id bigint, held_out boolean, score double, predicted int"),
        (6, "doc_id bigint, size bigint, source_size bigint, target double, taken bigint"),
        (9, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"),
        (10, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"),
        (11, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"),
        (12, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"),
        (13, "item_id bigint, rank int, doc_id bigint, score bigint"),
    ],
)
def test_contract(spark, sf_dir, number, columns):
    (name,) = [name for name in QUERIES if name.startswith(f"op{number}_")]
    frame = QUERIES[name](spark, sf_dir)
    kinds = dict(frame.dtypes)
    assert [(c.split()[0], kinds[c.split()[0]]) for c in columns.split(", ")] == [tuple(c.split()) for c in columns.split(", ")]
    if number not in (11, 13):  # these answer queries
        assert frame.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_all_are_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}
