"""The pipeline's stages on awkward rows and as a whole."""

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_contracts import brute_components, brute_line_dedup
from tests.llm.test_edges import none, odd  # noqa: F401  fixtures
from tidelog.llm import quality
from tidelog.llm.queries import WORD_TOKENIZER, tokenizer_file

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    """Each stage against brute force on its own input."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], SF).persist())
    texts = [{r["doc_id"]: r["text"] for r in s.collect()} for s in steps[:4]]
    assert all(s.columns == COLUMNS for s in steps[:5])
    assert texts[1].items() <= texts[0].items() and len(texts[1]) > 0.6 * len(texts[0])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([i in texts[1] for i, q in labels.items() if q == 1]) > 0.95
    assert texts[2] == brute_line_dedup(texts[1], 50)
    roots = brute_components(texts[2], 5, 80, 100)
    assert texts[3] == {i: t for i, t in texts[2].items() if roots[i][1] == i}
    mixed = steps[4].collect()
    assert {r["doc_id"] for r in mixed} <= set(texts[3]) and all(r["n_chars"] == len(r["text"]) for r in mixed)
    lib = Tokenizer.from_file(tokenizer_file(WORD_TOKENIZER))
    last = steps[5].collect()
    assert sorted(r["doc_id"] for r in last) == sorted(r["doc_id"] for r in mixed)
    known = {(r["doc_id"], tuple(lib.encode(r["text"] or "", add_special_tokens=False).ids)) for r in mixed}
    assert {(r["doc_id"], tuple(np.frombuffer(r["token_ids"], "<u4").tolist())) for r in last} == known


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "decoded"] and out.count() > 0


@pytest.mark.parametrize("k", range(5))
def test_awkward_rows(spark, odd, none, k):  # noqa: F811
    """Nulls, empty and long texts, repeats and extra columns whose names clash; what each stage makes of them."""
    _, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, none, SF).count() == 0
    out = stage(spark, odd, SF)
    got, given = [r.asDict() for r in out.collect()], [r.asDict() for r in odd.collect()]
    ids = sorted(r["doc_id"] for r in got)
    if k < 4:
        assert out.columns == odd.columns
        own = {r["doc_id"]: r for r in given}
        for r in got:  # clashing columns go through as they are
            assert all(r[c] == own[r["doc_id"]][c] for c in odd.columns if c not in ("text", "n_chars"))
    if k == 0:
        labels, texts = spark.read.parquet(f"{SF}/labels.parquet"), odd.select("doc_id", "text")
        scores = quality.score_quality(texts, quality.train_quality(odd, labels)).collect()
        assert ids == sorted(r["doc_id"] for r in scores if r["score"] >= 0.3)
    elif k == 1:
        assert ids == [1, 2, 3, 4, 5, 6, 7, 8, 8, 9]
        assert {r["doc_id"]: r["text"] for r in got}[6] == "own line\n\nlast" and all(r["text"] == own[r["doc_id"]]["text"] for r in got if r["doc_id"] != 6)
    elif k == 2:
        assert ids == [1, 2, 3, 4, 5, 7, 8, 8]  # 6 has the lines of 5, 9 is 8 in other letters
    elif k == 3:
        assert not {1, 2, 3} & set(ids) and {4, 5, 7} <= set(ids) and all(r["text"] == own[r["doc_id"]]["text"] for r in got)
    else:
        assert ids == [1, 2, 3, 4, 5, 6, 7, 8, 8, 9] and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
