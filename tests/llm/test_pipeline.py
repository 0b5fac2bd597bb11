import re

import corpus_pipeline
from parlance.llm import minhash
from parlance.llm.common import staged, table

SF = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(staged(stage(spark, kept[-1], SF), name))
    raw, good, exact, near, clean, packed = kept
    assert all(d.columns == columns for d in (good, exact, near, clean))
    texts = [r.text for r in good.collect()]
    assert 0.7 * raw.count() < len(texts) < raw.count()
    assert exact.count() == len(set(texts)) == exact.select("text").distinct().count()
    ids = {r.doc_id for r in near.collect()}
    classes = minhash.near_duplicates(exact).collect()
    assert ids == {r.class_id for r in classes} and len(ids) == near.count()
    after = {r.doc_id: r for r in clean.collect()}
    assert after.keys() == ids
    for r in after.values():
        assert r.n_chars == len(r.text) and not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)
    assert {r.doc_id for r in packed.collect()} == ids
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
