import hashlib
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from packloom.llm import langid, pii

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

EN = "the cat and the house with those things over there and more words about a garden of letters"
DE = "die katze und das haus mit diesen dingen dort und noch mehr wörter über einen garten voll buchstaben"
ITEM = "which river crosses seven borders before reaching its wide delta near old harbours. the answer names danube waters"


def rows():
    out = []
    for i in range(120):
        words = (EN if i % 2 else DE).split()
        k = i * 7 % len(words)
        body = " ".join(words[k:] + words[:k] + [f"{w}{'abcdefghij'[i % 10]}{'klmnopqrstuv'[i // 10]}" for w in words])
        out.append((i, body, "en" if i % 2 else "de"))
    out += [(200, out[10][1], "de"), (201, out[11][1] + " x", "en"), (202, "12345 --- 678", "en"), (203, None, "en"), (204, "", None)]
    out += [(205, out[3][1].replace("garden", "field") + " " + ITEM, "en"), (206, "write to jane@corp.example or +1 (017) 555-7713 about " + EN[::-1], "en")]
    return out


@pytest.fixture()
def folder(tmp_path):
    data = rows()
    docs = pa.table({"doc_id": pa.array([r[0] for r in data]), "text": pa.array([r[1] for r in data], pa.string()), "lang": pa.array([r[2] for r in data], pa.string()), "source": pa.array(["s"] * len(data)), "n_chars": pa.array([len(r[1] or "") for r in data])})
    pq.write_table(docs, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1]), "text": pa.array([ITEM])}), tmp_path / "benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = corpus_pipeline.identify_language(spark, docs, folder).cache()
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in first.collect()} == {202, 203, 204}
    second = corpus_pipeline.drop_near_copies(spark, first, folder).cache()
    assert {r.doc_id for r in first.collect()} - {r.doc_id for r in second.collect()} == {200, 201}
    third = corpus_pipeline.drop_benchmark_leaks(spark, second, folder).cache()
    assert {r.doc_id for r in second.collect()} - {r.doc_id for r in third.collect()} == {205}
    fourth = corpus_pipeline.sanitise_personal_data(spark, third, folder).cache()
    assert all(d.columns == docs.columns for d in (first, second, third, fourth))
    after = {r.doc_id: r for r in fourth.collect()}
    assert after[206].text.startswith("write to [EMAIL] or [PHONE] about") and after[206].n_chars == len(after[206].text)
    assert all(after[r[0]].text == r[1] for r in rows()[:120])
    assert sum(r.n_email for r in pii.find(fourth).collect()) == 0
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(after) and len(corpus_pipeline.STAGES) == 5
    assert all(got[i].decoded_sha256 == hashlib.sha256(after[i].text.encode()).hexdigest() for i in got)
    assert langid.UND not in {r.lang for r in after.values()}
