"""The pipeline against a plain version of its stages, each on what the one before kept."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import secrets as S
from quire.llm.quality_rules import STOP_WORDS, THRESHOLDS

from . import brute
from .test_texts import check_packed, reference_ids


def good(t):
    n, chars, symbols, dup, repeated = brute.measures(t)
    words = brute.WORD.findall(t or "")
    filled = sum(1 for x in (t or "").split("\n") if brute.WORD.search(x))
    measures = {
        "n_words": n, "repeat_ratio": repeated / max(n, 1), "mean_word_chars": chars / max(n, 1), "symbol_ratio": symbols / max(n, 1),
        "stop_ratio": sum(w in STOP_WORDS for w in words) / max(n, 1), "dup_line_ratio": dup / max(filled, 1),
    }
    holds = {"<": lambda a, b: a < b, ">": lambda a, b: a > b}
    return not (n < 20 or 100 * repeated > 30 * n or any(holds[op](measures[m], bound) for _, m, op, bound in THRESHOLDS))


def test_pipeline(spark, tmp_path):
    """Stage by stage, over whole documents of sf0.001 with copies, shared lines and planted secrets added, nulls and repeated rows."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in base.collect()]
    clean = [r for r in rows if good(r[1])]
    line = "Here is a line of some length that many of the documents share."
    token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    more = [(10_000 + i, f"{r[1]}\n{line}\nthe token = \"{token[i:]}{token[:i]}\" of it", *r[2:]) for i, r in enumerate(clean[:12])]
    more += [(15_000, " ".join(f"{r[1]}\n" for r in clean), "en", "s", 7)]  # all of them in one very long text
    more += [(20_000, None, "en", "s", 0), (20_001, "", "en", "s", 0), clean[0]]
    spark.createDataFrame(rows + more, base.schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    texts = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near copies", "secret scan", "packing"]
    kept = stages["quality rules"](spark, docs, str(tmp_path))
    expected = sorted((r[0], r[1]) for r in rows + more if good(r[1]))
    assert texts(kept) == expected and kept.columns == docs.columns

    lined = stages["line dedup"](spark, kept, str(tmp_path)).cache()
    by_id = brute.lines(dict(expected).items())
    expected = sorted((i, by_id[i]) for i, _ in expected)
    assert texts(lined) == expected and lined.where(F.col("n_chars") != F.length("text")).join(kept.where(F.col("n_chars") == F.length("text")), "doc_id", "left_semi").count() == 0

    single = stages["near copies"](spark, lined, str(tmp_path)).cache()
    near = brute.near(dict(expected).items(), 5)
    expected = [(i, t) for i, t in expected if near[i][1] == i]
    assert texts(single) == expected

    safe = stages["secret scan"](spark, single, str(tmp_path)).cache()
    expected = [(i, re.sub(r'(?<=token = ")[0-9a-f]{40}(?=")', S.SECRET, t)) for i, t in expected]
    assert texts(safe) == expected

    packed = stages["packing"](spark, safe, str(tmp_path)).collect()
    once = dict(expected)
    if len(once) == len(expected):
        check_packed(packed, expected, reference_ids())
    whole = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    total = lambda rows: sorted({(r["doc_id"], r["doc_tokens"]) for r in rows})
    assert total(whole) == total(packed) and {i for i, _ in total(whole)} == set(once)


def test_empty_table(spark, tmp_path):
    """Every stage gives an empty table with the columns that it should have, and so does the whole."""
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (out.columns == docs.columns or name == "packing")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
