"""Passages that few documents of many sources share."""

import corpus_pipeline as P

PASSAGE = " ".join(f"shared{i}" for i in range(60))


def test_shared_passage_stays_once(spark):
    rows = []
    for i in range(2000):
        lines = [f"own line {i}", f"another {i * 7} of document {i}"]
        if i % 250 == 3:  # 8 of 2,000 documents, each of another source
            lines.insert(1, PASSAGE)
        rows.append((i, "\n".join(lines), "en", f"s{i // 100}", 0))
    rows += [(5000, PASSAGE, "en", "s0", 0), (5001, None, "en", "s0", 0), (None, PASSAGE, "en", "s1", 0), (5002, " ".join(PASSAGE.split()[:49]), "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    stage = dict(P.STAGES)["line_dedup"]
    done = stage(spark, docs, "")
    assert done.schema == docs.schema
    got = done.collect()
    assert [r["doc_id"] for r in got if r["doc_id"] is not None and PASSAGE in (r["text"] or "")] == [3]
    want = {i: t if i is None or i == 3 or t is None else t.replace(PASSAGE + "\n", "") for i, t, *_ in rows if i != 5000}
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else 0) for r in got)
