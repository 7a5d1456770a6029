"""The pipeline against its stages done by hand, and on odd tables."""

import shutil

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from motifold.llm import bpe, decontaminate, pii, quality, simhash

DATA = "/root/testdata/sf0.001"


def slow_redaction(text, spans):
    out, at = [], 0
    for k, a, b in sorted(((k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)), key=lambda x: (x[1], pii.KINDS.index(x[0]))):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_pipeline_rows(spark):
    t = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    texts = dict(zip(t["doc_id"], t["text"]))
    kept = {r.doc_id for r in quality.quality_rules(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")).where("kept").collect()}
    prints = {d: simhash.fingerprint(texts[d]) for d in sorted(kept)}
    group = {d: d for d in prints}
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    kept = {d for d, g in group.items() if d == g}
    b = pq.read_table(f"{DATA}/benchmark.parquet").to_pydict()
    index = decontaminate.Index(list(zip(b["item_id"], b["text"])))
    kept = {d for d, own in zip(sorted(kept), index.matches([texts[d] for d in sorted(kept)])) if not own}
    spans = {r.doc_id: r.spans for r in pii.personal_data(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    redacted = {d: slow_redaction(texts[d], spans[d]) for d in kept}
    assert sum(redacted[d] != texts[d] for d in kept) > 3
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(kept)
    path, _ = bpe.default_vocabulary()
    plain = {i: token for token, i in bpe.read_ranks(path).items()}
    for r in rows:
        text = b"".join(plain[i] for i in r.ids).decode()
        assert r.n_tokens == len(r.ids) and text == redacted[r.doc_id]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "word " * 300, "en", "s", 1500), (2, "word " * 300, "en", "s", 1500)]])
def test_stages_on_odd_tables(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "'x' AS rid", "'y' AS Kept")
    for t in ("labels", "benchmark"):
        shutil.copy(f"{DATA}/{t}.parquet", tmp_path)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, str(tmp_path))
        assert out.count() <= len(rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
