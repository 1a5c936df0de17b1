"""The pipeline stage by stage: columns, kept rows, and what brute force says of those that have one."""

import hashlib

from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_duplicates import brute_groups
from tests.llm.test_text_operators import PATH, brute_report

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        rows = out.collect()
        after = {r["doc_id"] for r in rows}
        assert after <= set(before) and len(rows) == len(after)
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            trusted = [d for d in before if d in labels and labels[d]["quality"] == 1]
            assert sum(d in after for d in trusted) >= 0.97 * len(trusted)
        elif k == 1:
            marked = [d for d in before if d in labels]
            assert sum((d in after) == (labels[d]["toxic"] != 1) for d in marked) >= 0.9 * len(marked)
        elif k == 2:
            assert after == {c for _, _, c in brute_groups(list(before.items()))}
        elif k == 3:
            assert after == {r[0] for r in brute_report(list(before.items()), items) if not r[-1]}
        else:
            library = Tokenizer.from_file(PATH)
            library.no_truncation()
            library.no_padding()
            assert after == set(before)
            for r in rows:
                ids = library.encode(before[r["doc_id"]] or "", add_special_tokens=False).ids
                assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        docs, before = out, {r["doc_id"]: r["text"] for r in rows} if k < 4 else {}
