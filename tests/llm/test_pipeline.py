import corpus_pipeline
from surefact.llm.common import table


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
    ids = {r.doc_id for r in now.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


def test_empty_tables(spark, sf):
    now = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
    assert now.count() == 0


def test_stages_equal_brute_force(spark, sf):
    """Each stage by plain Python on what the one before kept."""
    import re

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from pyspark.sql import functions as F

    from surefact.llm import queries, secrets, simhash, toxicity
    from surefact.llm.common import doc_bucket

    docs = table(spark, sf, "documents").cache()
    stage = dict(corpus_pipeline.STAGES)
    labels = table(spark, sf, "labels").where(doc_bucket(F.col("doc_id"), 3) != 1)
    score = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels), evidence=False).collect()}
    clean = stage["toxicity"](spark, docs, sf).cache()
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, s in score.items() if s < 0.7)
    rows = sorted((r.doc_id, r.text or "") for r in clean.collect())
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                up[max(root(a), root(b))] = min(root(a), root(b))
    once = stage["near_duplicates"](spark, clean, sf).cache()
    assert sorted(r.doc_id for r in once.collect()) == [rows[k][0] for k in range(len(rows)) if root(k) == k]
    redacted = {r.doc_id: r.text for r in stage["secrets"](spark, once, sf).collect()}
    for r in once.collect():
        spans = sorted((m.start(), m.end()) for rule in secrets.RULES for m in re.finditer(rule.pattern, r.text or "", re.A | (re.I if rule.fold else 0)) if len(m.group(rule.group)) >= rule.least)
        out, end = "", 0
        for a, b in spans:
            if a >= end:
                out += r.text[end:a] + "[secret]"
            end = max(end, b)
        assert redacted[r.doc_id] == (out + r.text[end:] if spans else r.text)
    t = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    t.no_padding(), t.no_truncation()
    got = {}
    for r in stage["packing"](spark, stage["secrets"](spark, once, sf), sf).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    import zlib

    for i, text in redacted.items():
        ids, at = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for start, n, crc in sorted(got[i]):
            assert start == at and zlib.crc32(ids[at : at + n].tobytes()) == crc
            at += n
        assert at == len(ids)
