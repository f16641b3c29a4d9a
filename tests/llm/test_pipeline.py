import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brisa.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import prose
from tests.llm.test_simhash import groups, mark
from tests.oracle import connect, differences
from tests.test_oracle import FOLDER

SAME = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_empty_tables(spark, folder, odd, none, name, stage):
    for docs in (odd, none):
        out = stage(spark, docs, folder)
        if name != "best_fit_packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = out.count()
        assert rows > 0 if docs is odd else rows == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_named_as_inside(spark, folder, odd, name, stage):
    names = ["spans_", "spans_of_", "cut_", "cut", "row", "copies_", "copies", "taken_id_", "copy_", "col", "rows_", "least_", "spans"]
    docs = odd.select(*SAME, *[F.concat(F.lit(n), F.coalesce("text", F.lit(""))).alias(n) for n in names])
    before = {(r["doc_id"], *(r[n] for n in names)) for r in docs.collect()}
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns
    after = {(r["doc_id"], *(r[n] for n in names)) for r in out.collect()}
    assert after and after <= before


def test_simhash_stage_keeps_one_of_each_group(spark, folder, odd, given):
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, folder).collect()
    named = [(i, t) for i, t, _ in given if i is not None]
    roots = groups([mark(t) for _, t in named], 4)
    want = {min(named[j][0] for j in range(len(named)) if roots[j] == r) for r in roots}
    got = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert sorted(got) == sorted(set(got)) and set(got) <= want
    assert sum(r["doc_id"] is None for r in kept) == 2


def test_cut_stage_keeps_first_places(spark, folder, odd):
    rows = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, odd, folder).collect()}
    assert len(rows[9]["text"]) > 0 and rows[10]["text"] == "" and rows[10]["n_chars"] == 0
    assert rows[3]["text"] is None and rows[4]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values() if r["text"])


def test_cut_stage_takes_passages_of_over_50_words(spark, folder, frame):
    """51 shared words of about 6 letters, of one letter, and with other white space go from later documents; 50 stay."""
    medium, short, fifty = prose(80, 51), " ".join(chr(97 + i * i * 5 % 26) for i in range(51)), prose(81, 50)
    assert all(len(t) < 400 for t in (medium, short, fifty)) and len(short) == 101
    shared = [medium, short, fifty, medium.replace(" ", "\n ")]
    rows = [(0, f"{prose(50, 30)} {medium} {prose(51, 30)} {short} {prose(52, 30)} {fifty} é")]
    rows += [(i, f"é{prose(60 + i, 30)} é{i} {shared[i - 1]} ü{i} {prose(70 + i, 30)}") for i in range(1, 5)]
    found = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, frame(rows), folder).collect()}
    want = {i: t if i in (0, 3) else t.replace(shared[i - 1], "") for i, t in rows}
    assert {i: r["text"] for i, r in found.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_mixing_stage_repeats_documents(spark, folder, odd):
    rows = corpus_pipeline.mix_sources(spark, odd.where("doc_id < 11"), folder).collect()
    assert all(sum(r == q for q in rows) <= 2 for r in rows)


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing_sources", "best_fit_packing"
    ]
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").isEmpty()
    assert found.select("doc_id").distinct().count() > 100


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) == []


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
