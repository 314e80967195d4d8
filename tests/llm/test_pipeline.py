import pytest

import corpus_pipeline as pipeline
from kinloom.llm import queries, toxicity

from .test_operators import documents, library, near_sets, packed_well, removed_lines, roots, word_sets


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus: the first documents of a table and all its labels."""
    at = f"file://{tmp_path_factory.mktemp('sf')}"
    source = "/root/testdata/sf0.001"
    queries.table(spark, source, "documents").where("doc_id < 120").write.parquet(f"{at}/documents.parquet")
    queries.table(spark, source, "labels").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_equal_brute_force(spark, folder):
    docs = queries.table(spark, folder, "documents")
    columns, out = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder).persist()
        assert name == "packing" or docs.columns == columns
        out[name] = (before.collect(), docs.collect())
    text = lambda rows: {r.doc_id: r.text for r in rows}
    first, kept = out["toxicity"]
    source = queries.table(spark, folder, "documents")
    scores = {r.doc_id: r.predicted for r in toxicity.scored(source, toxicity.fitted(source, queries.table(spark, folder, "labels"))).collect()}
    assert text(kept) == {i: t for i, t in text(first).items() if not scores[i]}
    first, kept = out["line_dedup"]
    gone, want = removed_lines(text(first)), {}
    for i, t in text(first).items():
        left = [x for k, x in enumerate((t or "").split("\n")) if k not in gone.get(i, ())]
        if i not in gone or "".join(left).strip():
            want[i] = t if t is None else "\n".join(left)
    assert text(kept) == want and all(r.n_chars == len(r.text or "") or r.text is None for r in kept)
    first, kept = out["minhash_dedup"]
    sets = word_sets(text(first), 5)
    part = roots(sets, near_sets(sets))
    assert text(kept) == {i: t for i, t in text(first).items() if part[i] == i}
    first, kept = out["secrets"]
    assert set(text(first)) == set(text(kept))
    t = library("byte_bpe_50k.json")
    packed_well(out["packing"][1], text(kept), lambda x: t.encode(x, add_special_tokens=False).ids)


def test_run_and_hard_rows(spark, folder, hard, empty):
    assert pipeline.run(spark, folder).count() > 0
    for docs in (hard, empty):
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, folder)
        docs.collect()
