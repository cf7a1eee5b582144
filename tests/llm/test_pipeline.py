"""The pipeline against its stages by brute force, and the SQL of the queries that have it."""

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from seriesmill.llm import queries, repeats
from tests.llm.test_contracts import measures, removed
from tests.llm.test_near_copies import exact_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    out = corpus_pipeline.settle(steps["quality_rules"](spark, docs, SF), "t")
    kept = set()
    for i, t in rows.items():
        n, chars, symbols, dup, repeat = measures(t)
        lines = len([x for x in t.split("\n") if x.split()])
        if not (n < 50 or 100 * repeat > 50 * n or 10 * symbols > 4 * n or 10 * dup > 5 * lines or chars < 2 * n or chars > 25 * n):
            kept.add(i)
    assert {r.doc_id for r in out.collect()} == kept and out.columns == docs.columns
    out = corpus_pipeline.settle(steps["simhash_dedup"](spark, out, SF), "t")
    roots = exact_groups({i: rows[i] for i in kept})
    kept = {i for i in kept if roots[i] == i}
    assert sorted(r.doc_id for r in out.collect()) == sorted(kept) and out.columns == docs.columns
    out = corpus_pipeline.settle(steps["suffix_array_dedup"](spark, out, SF), "t")
    want = removed({i: rows[i].encode() for i in kept})
    for r in out.collect():
        if not want[r.doc_id]:
            assert r.text == rows[r.doc_id]
        assert r.n_chars == len(r.text) and len(r.text.encode()) <= len(rows[r.doc_id].encode()) - sum(b - a for a, b in want[r.doc_id])
    before = out.count()
    out = corpus_pipeline.settle(steps["mixing"](spark, out, SF), "t")
    assert out.columns == docs.columns and before == len(kept)
    texts = {r.doc_id: r.text for r in out.collect()}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = steps["bpe"](spark, out, SF).collect()
    assert len(got) == out.count()
    for r in got:
        assert r.ids == t.encode(texts[r.doc_id], add_special_tokens=False).ids and r.decoded == texts[r.doc_id]


def test_stages_take_odd_rows(spark, odd):
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.settle(stage(spark, docs, SF), "t")
            assert name == "bpe" or out.columns == docs.columns
            out.count()


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toArrow(), con.sql(queries.ORACLE[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*[t.column(c).to_pylist() for c in columns])))
    assert rows(got) == rows(want)


def test_texts_without_repeats_are_not_moved(make, monkeypatch):
    """Only texts with a context that repeats, and only texts that lose something, meet the joins by document."""
    seen, marks = [], repeats.marks
    monkeypatch.setattr(repeats, "marks", lambda hashes: seen.append(hashes.distinct().count()) or marks(hashes))
    shared = " ".join(f"shared{i}" for i in range(40))
    own = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(30)]
    rows = {i: t for i, t in enumerate(own)} | {30: own[0] + " " + shared, 31: shared + " " + own[5][:50]}
    out = repeats.without_repeats(make([(i, t, "en", "a") for i, t in rows.items()])).collect()
    want = removed({i: t.encode() for i, t in rows.items()})
    assert len(out) == 32 and all((r.text == rows[r.doc_id]) == (not want[r.doc_id]) for r in out)
    assert 0 < max(seen) <= 4
