import hashlib

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from docket.llm import toxicity
from docket.llm.common import materialise
from docket.llm.queries import piece_model
from docket.session import read_table

from . import test_line_dedup, test_ngram_join

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark):
    docs = read_table(spark, DIR, "documents")
    odd = spark.createDataFrame([(100_000, None, "en", "s", 0), (100_001, "", None, None, None), (None, "a text without any id at all", "en", "s", 1)], docs.schema)
    docs = materialise(docs.unionByName(odd), "t")
    model = toxicity.fit(docs, read_table(spark, DIR, "labels"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]

    def step(name, docs):
        out = materialise(stages[name](spark, docs, DIR), "t")
        return out, sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) if "text" in out.columns else None

    out, got = step("toxicity", docs)
    keep = model.scores([t for _, t in rows]) < 0.5
    assert got == sorted((r for r, k in zip(rows, keep, strict=True) if k), key=str) and out.columns == COLUMNS
    assert 0 < len(got) < len(rows)

    clean = test_line_dedup.brute(got)
    want = sorted([(i, c) for i, t, c in clean if not (c != t and not c.strip())], key=str)
    out, got = step("line dedup", out)
    assert got == want and out.columns == COLUMNS
    assert out.filter("n_chars <> length(text)").count() == 0

    want = sorted([(i, t) for (i, t), (j, _, c) in zip(sorted(got, key=str), sorted(test_ngram_join.brute(got), key=str), strict=True) if i == j and (i == c or i is None)], key=str)
    out, got = step("n-gram Jaccard join", out)
    assert got == want and out.columns == COLUMNS

    before, (out, after) = got, step("mixing sources to target weights", out)
    assert out.columns == COLUMNS and set(after) == set(before)
    tokens = {r["lang"]: r["n"] for r in out.groupBy("lang").agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).collect() if r["lang"]}
    total = sum(tokens.values())
    assert all(abs(tokens[d] / total - w) < 0.12 for d, w in P.MIX_WEIGHTS.items())

    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    last = stages["SentencePiece encoding and decoding"](spark, out, DIR).collect()
    ids = [(i, library.encode(t or "")) for i, t in after]
    assert sorted(((r["doc_id"], list(r["ids"])) for r in last), key=str) == sorted(ids, key=str)
    assert all(r["parity"] and r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], dtype="<i4").tobytes()).hexdigest() for r in last)


def test_whole_run_and_empty_table(spark, tmp_path):
    assert P.run(spark, DIR).count() > 100
    empty = read_table(spark, DIR, "documents").limit(0)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    read_table(spark, DIR, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
