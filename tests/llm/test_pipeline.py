from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np

import __spark_entry__
from evidentia.llm import common, decontaminate, packing, secret_scan, toxicity

from test_near_copies import brute_survivors


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert names["pipeline"] is corpus_pipeline.run


def test_stages_on_given_documents(spark, folder):
    """Every stage against a plain program on its own input."""
    docs = common.table(spark, folder, "documents")
    columns = docs.columns
    key = lambda r: (r.doc_id, r.text)
    items = [tuple(r) for r in common.table(spark, folder, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = common.cut(stage(spark, docs, folder))
        assert docs.columns == columns, name
        after = docs.collect()
        if name == "toxicity":
            labels = common.table(spark, folder, "labels")
            model = toxicity.train(common.table(spark, folder, "documents"), labels)
            scorer = toxicity.Scorer(model)
            score = lambda r: model.score(*scorer.count((r.text or "").encode().lower()))  # noqa: E731, B023
            assert sorted(map(key, after)) == sorted(key(r) for r in before if score(r) < toxicity.THRESHOLD)
        elif name == "near_duplicates":
            # The stage joins two differing bits and a five-word similarity of 0.8.
            assert sorted(r.doc_id for r in after) == brute_survivors([(r.doc_id, r.text) for r in before])
        elif name == "decontamination":
            windows = decontaminate.WindowSet(items)
            clean = []
            for r in before:
                (n, ranges, _), = decontaminate.scan([(r.text or "").encode()], windows)
                n_hit = sum(b - a for a, b in ranges)
                if not (n_hit and 20 * n_hit >= n):
                    clean.append(key(r))
            assert sorted(map(key, after)) == sorted(clean)
        else:
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
            texts = {r.doc_id: r.text for r in before}
            changed = [r for r in after if r.text != texts[r.doc_id]]
            assert changed and all("[SECRET]" in r.text and r.n_chars == len(r.text) for r in changed)
            table = secret_scan.train(secret_scan.samples(docs))
            left = secret_scan.report(docs, table).where("n_assign + n_access + n_hex > 0").count()
            assert left == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    encoder = packing.Encoder(packing.public_tokenizer())
    want = {}
    for r in docs.collect():
        ids = np.frombuffer(encoder.ids(r.text or ""), dtype="<u4").tolist() + [0]
        for at in range(0, len(ids), 1024):
            want[r.doc_id, at] = zlib.crc32(np.array(ids[at : at + 1024], dtype="<u4").tobytes())
    assert {(r.doc_id, r.start): r.ids_crc32 for r in out} == want


def test_stages_keep_odd_rows_and_columns(spark, make, folder):
    rows = [(1, None), (2, ""), (3, "some words"), (3, "some words"), (None, "no id here"), (4, "é" * 50_000)]
    frame = make(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = common.cut(stage(spark, frame, folder))
        assert frame.columns == make(rows).columns
    # 1 and 2 have the same fingerprint; of the repeated row one stays.
    assert sorted(str(r.doc_id) for r in frame.collect()) == ["1", "3", "4", "None"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, make([]), folder).count() == 0


def test_run_equals_its_stages(spark, folder):
    docs = common.table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, folder))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(corpus_pipeline.run(spark, folder).select(cols).collect()) == sorted(docs.select(cols).collect())
