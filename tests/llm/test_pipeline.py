"""The whole pipeline over small tables: what is kept and what is not, by brute force."""

import random

import numpy as np
import public_tokenizers
import pytest
from llm_data import SCHEMA, corpus, prose
from test_pairs import classes
from test_texts import base_spans

import corpus_pipeline


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(11)
    item = prose(rng, 25)
    rows = [(i, prose(rng, 70), "en", "s", 0) for i in range(150)]
    rows += [(200 + i, t, "en", "s", 0) for i, (_, t, *_) in enumerate(corpus(4)) if t and len(t) > 60]
    rows += [(900 + i, f"{prose(rng, 40)} {item} {prose(rng, 20)}", "en", "s", 0) for i in range(4)]
    rows += [(950 + i, prose(rng, 40).upper().replace(" ", "$$$ "), "en", "s", 0) for i in range(5)]
    rows += [(970, prose(rng, 60) + ' token = "0123456789abcdef0123"', "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 900), 0) for i, *_ in rows if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, item


def test_pipeline(spark, tables):
    import sentencepiece

    folder, rows, item = tables
    made = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    texts = {r[0]: r[1] for r in rows}
    assert len(made) == len(set(made)) and made.keys() <= texts.keys()
    # Junk and leaks are gone, clean texts of their own stay.
    assert not any(950 <= i < 960 or 900 <= i < 904 for i in made)
    assert sum(i in made for i in range(150)) >= 147
    # Of every group that links joined, one document is there, and no link is left.
    judged = corpus_pipeline.keep_good(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    kept = [(r.doc_id, r.text) for r in judged.collect()]
    expected = {c for _, _, c in classes(kept)} - {i for i, t in texts.items() if item in t}
    assert expected == made.keys()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in made.items():
        assert not base_spans(r.text)
        assert r.text == texts[i] or base_spans(texts[i])
        ids = library.encode(r.text, add_bos=True, add_eos=True)
        assert np.frombuffer(r.piece_ids, "<u4").tolist() == ids and r.round_trip
