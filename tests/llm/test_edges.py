"""Null and equal keys, clashing names and empty tables, through the stages, and the
registered queries with their SQL on small tables."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from packloom.llm import langid, neardup, pii, queries, warc

EN = "the cat and the house with those things over there and more words about a garden of letters"
DE = "die katze und das haus mit diesen dingen dort und noch mehr wörter über einen garten voll buchstaben"
CLASHES = "doc_id long, text string, lang string, source string, n_chars long, __t int, email string, `__terms` int, __leaks_found int, __text string, score int, lang_pred string, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 8) for r in rows], CLASHES)


@pytest.mark.parametrize("key", [None, 3, 7])
def test_language_is_learned_whatever_the_keys(spark, key):
    rows = [(key, f"{(EN, DE)[i % 2]} {i} {'xyz'[i % 3] * (i % 9 + 1)}", ("en", "de")[i % 2], "s", 1) for i in range(300)]
    docs = frame(spark, rows + rows[:40])
    model = langid.fit(docs)
    assert model.labels == ["de", "en"]
    got = langid.predict(docs, model, docs.columns)
    assert got.columns == [*docs.columns, "lang_pred", "score"]
    place = got.toDF(*(f"c{i}" for i in range(len(got.columns))))
    assert place.where("c2 <> c13").count() == 0


def test_stages_keep_clashing_columns(spark):
    pytest.importorskip("public_tokenizers")
    rows = [(None, EN, "en", "s", 1), (None, EN, "en", "s", 1), (4, DE + " write to jane@corp.example", "de", "s", 1), (4, EN + " more", "en", "s", 1), (5, None, None, None, None), (6, "", "en", "s", 0)]
    docs = frame(spark, rows)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 5 - 1
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and sum("[EMAIL]" in (r[1] or "") for r in clean.collect()) == 1
    import corpus_pipeline

    for stage in (corpus_pipeline.identify_language, corpus_pipeline.sanitise_personal_data):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0


def test_null_keys_are_no_cross_join(spark):
    rows = [(None, f"{EN} {i // 2} {i // 2 + 1}") for i in range(60)]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 60 and all(r.n_links >= 1 for r in got)


def test_revisits_of_equal_rows(spark):
    rows = [(1, "x"), (1, "x"), (2, "x"), (None, "x"), (None, "y"), (3, "y")]
    got = warc.mark_revisits(spark.createDataFrame(rows, "key long, payload string"), "key", "payload").collect()
    assert sorted((r.key or 0, r.payload, r.refers_to or 0) for r in got) == [(0, "x", 1), (0, "y", 3), (1, "x", 0), (1, "x", 0), (2, "x", 1), (3, "y", 0)]


def test_registered_queries(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    docs = [(i, f"{(EN, DE)[i % 2]} {'abcdef'[i % 6]}{i // 6}", ("en", "de")[i % 2]) for i in range(40)]
    docs += [(50, docs[3][1], "de"), (51, docs[4][1] + " token = 'aB3dE5fG7hJ9' jane@corp.example", "en"), (52, None, None), (53, "", "en")]
    pq.write_table(pa.table({"doc_id": [d[0] for d in docs], "text": pa.array([d[1] for d in docs], pa.string()), "lang": pa.array([d[2] for d in docs], pa.string()), "source": ["s"] * len(docs), "n_chars": [len(d[1] or "") for d in docs]}), tmp_path / "documents.parquet")
    pages = [(1, "u", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "v", None), (4, "w", ""), (5, "x", "é")]
    pq.write_table(pa.table({"page_id": [p[0] for p in pages], "url": pa.array([p[1] for p in pages], pa.string()), "html": pa.array([p[2] for p in pages], pa.string())}), tmp_path / "pages.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [" ".join(docs[7][1].split()[3:])]}), tmp_path / "benchmark.parquet")
    vectors = [(i, i % 3, [((i * 7 + j * 5) % 11) / 11 - 0.3 for j in range(4)]) for i in range(120)] + [(200, None, [0.1] * 4), (300, 1, None), (None, 1, [0.2] * 4), (100, 1, [0.5] * 4)]
    pq.write_table(pa.table({"vec_id": pa.array([v[0] for v in vectors], pa.int64()), "embedding": pa.array([v[2] for v in vectors], pa.list_(pa.float32())), "label": pa.array([v[1] for v in vectors], pa.int32())}), tmp_path / "embeddings.parquet")
    turns = [(c, t, ("user", "assistant", "system", "", None)[(c * t) % 5], ("Yes.", "no", "", None, f"t{t}!")[(c + t) % 5]) for c in range(30) for t in range(6)] + [(None, None, None, None), (None, 1, "user", "x.")]
    pq.write_table(pa.table({"conv_id": pa.array([t[0] for t in turns], pa.int64()), "turn": pa.array([t[1] for t in turns], pa.int64()), "role": pa.array([t[2] for t in turns], pa.string()), "text": pa.array([t[3] for t in turns], pa.string())}), tmp_path / "conversations.parquet")
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    for name, query in queries.QUERIES.items():
        out = query(spark, str(tmp_path))
        rows = out.collect()
        if name in queries.ORACLE:
            want = con.execute(queries.ORACLE[name])
            cols = [d[0] for d in want.description]
            assert sorted(out.columns) == sorted(cols)
            key = lambda r: str(r)
            assert sorted((tuple(r[c] for c in cols) for r in rows), key=key) == sorted(want.fetchall(), key=key), name
        elif name.startswith("op9"):
            assert 7 in {r.doc_id for r in rows}
        else:
            assert len(rows) == len(docs), name
