import duckdb
import pytest

import __spark_entry__ as entry
from tramsu.plans import queries as core
from tramsu.sources import readers, sinks


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "á"), (2, None)], "n int, s string")
    sinks.write_csv(df, str(tmp_path / "c"), bom=True)
    assert readers.read_csv(spark, str(tmp_path / "c")).columns == ["n", "s"]
    sinks.write_parquet(df, str(tmp_path / "a"))
    got = readers.read_splits(spark, {"train": str(tmp_path / "a"), "dev": str(tmp_path / "a")})
    assert sorted((r["n"], r["split"]) for r in got.collect()) == [(1, "dev"), (1, "train"), (2, "dev"), (2, "train")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "x.json").write_text('[{"ID": "1"}, {"ID": "2"}]')
    (tmp_path / "j" / "y.json").write_text("[{")
    assert sorted(r["ID"] for r in readers.read_json_arrays(spark, str(tmp_path / "j"), "ID string").collect()) == ["1", "2"]
    (tmp_path / "l.jsonl").write_text('{"item_id": "i", "verification": {"status": "accepted"}}\n\nnonsense\n')
    bank = readers.flat_bank(readers.read_items(spark, str(tmp_path / "l.jsonl"))).collect()
    assert [(r["item_id"], r["verifier_score"], r["evidence_match"]) for r in bank] == [("i", 0.5, 0.0)]
    sinks.write_report(df.where("s is not null"), str(tmp_path / "t"), "%d: %s", "n", "s")
    assert "question" in sinks.item_schema(spark)


def test_streams(spark, tmp_path, data):
    from tramsu.streaming import checks

    table = spark.read.parquet(f"{data}/exam_dashboard.parquet").select("item_id", "question", "answer_key", "created_at")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("q", checks.distinct_questions(stream), "append"), ("k", checks.key_counts(stream), "complete")):
        run = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        run.processAllAvailable()
        run.stop()
    assert spark.sql("select sum(n) from k").first()[0] == table.count()
    assert 0 < spark.sql("select count(*) from q").first()[0] <= table.count()


def canon(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return repr(list(map(canon, v))) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in "corpus qa_pairs entities exam_dashboard documents exam_items nicknames exam_blueprint embeddings".split():
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.sql(core.oracle_sql()[name])
    cols = sorted(want.columns)
    got = core.queries()[name](spark, data)
    assert sorted(got.columns) == cols
    assert sorted(canon([r[c] for c in cols]) for r in got.collect()) == sorted(canon([r[want.columns.index(c)] for c in cols]) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
