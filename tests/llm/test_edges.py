"""Empty tables, all-null rows, repeated rows and clashing columns, for every operator and stage."""

import public_tokenizers
import pytest
from llm_data import SCHEMA
from pyspark.sql import functions as F

import corpus_pipeline
from varimill.llm import (
    decontaminate,
    jaccard_join,
    pieces,
    quality_model,
    quality_rules,
    secrets,
    substring_dedup,
    token_counts,
    toxicity,
    url_filter,
)

NULLS = (None, None, None, None, None)
ROW = (1, "some plain text of words", "en", "s", 3)
CASES = {"empty": [], "nulls": [NULLS, NULLS], "repeated": [ROW, ROW, ROW], "mixed": [NULLS, ROW, (2, "", "en", None, 0)]}
CLASHING = ("leaks", "score", "kept", "n_tokens", "piece_ids", "bits", "node", "class", "host", "found", "_id", "end", "value")
# Names that an operator uses on the way: the caller's columns keep their values.
ON_THE_WAY = (*url_filter._TAKEN, *secrets._TAKEN, "Depth2", "class_key", "text_key", "row_key")


def _operators(spark):
    items = spark.createDataFrame([(1, "plain text of"), (None, None)], "item_id long, text string")
    trusted = spark.createDataFrame([(1,), (None,)], "doc_id long")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    model = public_tokenizers.path("piece_bpe_32k.model")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return {
        "url_filter": lambda d: url_filter.judge(d.withColumn("url", F.col("text"))),
        "quality_model": lambda d: quality_model.classify(d, trusted),
        "jaccard_join": jaccard_join.join_classes,
        "quality_rules": quality_rules.judge,
        "secrets": secrets.report,
        "substring_dedup": lambda d: substring_dedup.remove_repeats(d, buckets=2),
        "token_counts": lambda d: token_counts.token_lengths(d, ranks, public_tokenizers.PATTERN),
        "pieces": lambda d: pieces.encode_decode(d, model),
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "decontaminate": lambda d: decontaminate.with_leaks(d, items),
    }


OPERATORS = (
    "url_filter quality_model jaccard_join quality_rules secrets substring_dedup token_counts pieces toxicity"
    " decontaminate"
).split()


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables_give_a_row_per_row(spark, name):
    operator = _operators(spark)[name]
    for rows in CASES.values():
        assert operator(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_are_no_matter(spark, name):
    docs = spark.createDataFrame(CASES["mixed"], SCHEMA).withColumns({c: F.lit("x") for c in CLASHING})
    assert _operators(spark)[name](docs).count() == 3


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    spark.createDataFrame([(1, "an item of a few words")], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    return folder


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_tables(spark, tables, number):
    stage = corpus_pipeline.STAGES[number][1]
    for rows in CASES.values():
        docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in CLASHING})
        made = stage(spark, docs, tables)
        kept = made.collect()
        assert len(kept) <= len(rows)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert set(made.columns) == set(docs.columns)
        if rows == CASES["repeated"]:
            assert len(kept) == (1 if number == 1 else 3)


@pytest.mark.parametrize("name", ["url_filter", "secrets", "redact"])
def test_columns_of_the_caller_keep_their_values(spark, name):
    rows = [(1, "https://a.b.de/x password=0123456789abc", "en", "s", 3), (2, "http://c.org/y", "en", "s", 0), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.concat(F.lit(c), "doc_id") for c in ON_THE_WAY})
    operators = _operators(spark) | {"redact": secrets.redact}
    made = operators[name](docs)
    assert len({c.lower() for c in made.columns}) == len(made.columns)
    for row in made.collect():
        assert all(row[c] == f"{c}{row.doc_id}" for c in ON_THE_WAY)
