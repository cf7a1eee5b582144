"""Columns of any name pass the pipeline's stages unchanged; operators ignore them."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seriesmill.llm import mixing, near_copies, quality_rules, repeats, simhash

# names that stages and operators use inside
NAMES = (
    "_key _nth _n null_text target copies source_size whole threshold row id key nth n ord var h raw spans cut node root fp sketch weight size short "
    "a b u v m p first_id component_id gram kind kinds at context left right start end run new x y bucket tokens prefix under upto rest s level water "
    "_kept_id _kept_key _cut_source ids decoded failed_bits kept e r text_crc32 slot"
).split()


@pytest.fixture(scope="module")
def extra(make):
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(i, " ".join(f"w{(i * 37 + j * j) % 991}" for j in range(120)) + (" " + passage if i % 3 == 0 else ""), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(8)] + [(200, None, None, None), (None, rows[3][1], "en", "s1"), (201, "", "en", None)]
    docs = make(rows)
    return docs, docs.select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES])


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[:-1]], ids=lambda s: s[0])
def test_stages_keep_them(spark, extra, stage):
    plain, docs = extra
    name, run = stage
    out = run(spark, docs, None)
    assert out.columns == docs.columns
    for r in out.collect():
        assert all(r[n] == f"{n} of {r.doc_id if r.doc_id is not None else '-'}" for n in NAMES)
    key = lambda rows: sorted((str(r.doc_id), str(r.text), str(r.source)) for r in rows)
    assert key(out.collect()) == key(run(spark, plain, None).collect())


def test_operators_ignore_them(extra):
    plain, docs = extra
    same = lambda f: sorted(map(str, f(plain).collect())) == sorted(map(str, f(docs).collect()))
    assert same(lambda d: simhash.near_duplicates(d)) and same(lambda d: near_copies.near_copies(d))
    assert same(lambda d: repeats.remove_repeats(d)) and same(lambda d: mixing.cuts(d, seed=1))
    assert same(lambda d: quality_rules.ledger(d).select("doc_id", "n_words", "failed_bits"))
