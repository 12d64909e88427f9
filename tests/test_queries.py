"""Every core query against its SQL on the smallest supplied tables, the library from end to end, the command line, streaming."""

import importlib
import sys

import pytest
from pyspark.sql import functions as F

from loomgraph import cli, pipeline
from loomgraph.plans import queries
from loomgraph.sources import tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, data, db, name):
    df = queries.QUERIES[name](spark, data)
    rows = df.collect()
    assert rows
    if name in queries.SQL:
        cursor = db.execute(queries.SQL[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert plain(rows, df.columns) == plain(cursor.fetchall(), columns)


def test_report_timeline_takes_the_first_stored_of_equal_lines(spark, tmp_path):
    import datetime as dt

    day = lambda d: dt.datetime(1997, 5, d)
    spark.createDataFrame([(1, day(1))], "o_orderkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(7, "Seven")], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    # Spark reads the larger file first; the one of the lesser name holds the line that counts
    schema = "l_orderkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_shipdate timestamp"
    more = [(k, 8, 1, "R", day(3)) for k in range(1000, 3000)]
    for i, rows in enumerate(([(1, 7, 1, "N", day(20))], [(1, 7, 1, "N", day(10)), *more])):
        spark.createDataFrame(rows, schema).coalesce(1).toPandas().to_parquet(str(tmp_path / f"{i}.parquet"), coerce_timestamps="us")
    (tmp_path / "lineitem.parquet").mkdir()
    for i in range(2):
        (tmp_path / f"{i}.parquet").rename(tmp_path / "lineitem.parquet" / f"part-{i}.parquet")
    got = {(r.date, r.name) for r in queries.QUERIES["report_timeline"](spark, str(tmp_path)).collect()}
    assert got == {("1997-05-01", "Order 1"), ("1997-05-20", "Seven")}


def test_staleness_of_odd_documents_equals_sql(spark, tmp_path):
    import duckdb

    rows = [(i, s, la, n) for i, (s, la, n) in enumerate((s, la, n) for s in ("a", "b", "", None) for la in ("en", "de", "", None) for n in (100, 7, 0, None))]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long").write.parquet(path)
    for where in ("true", "source <> ''"):
        spark.read.parquet(path).where(where).write.parquet(str(tmp_path / f"of-{where[0]}" / "documents.parquet"))
        got = queries.QUERIES["staleness_split"](spark, str(tmp_path / f"of-{where[0]}")).collect()
        c = duckdb.connect()
        c.execute(f"create view documents as select * from read_parquet('{tmp_path}/of-{where[0]}/documents.parquet/*.parquet')")
        assert sorted(map(tuple, got), key=repr) == sorted(c.execute(queries.SQL["staleness_split"]).fetchall(), key=repr)


def test_entry_without_training_data_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(queries.QUERIES)
    sys.modules.pop("__spark_entry__", None)


def test_library_and_command_line(spark, tmp_path, capsys):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "one.txt").write_text("In spring Alice Smith met Bob Jones. Later Alice Smith joined Acme Corp with Bob Jones.")
    (docs / "two.txt").write_text("The board of Acme Corp thanked Alice Smith. Then Carol White left Acme Corp.")
    out = str(tmp_path / "out")
    assert cli.main(["extract", str(docs), "-o", out], spark) == 0
    assert pipeline.run_extract(spark, str(docs), out).count() == 2  # nothing is stale, nothing is lost
    for command in (["build"], ["resolve"], ["review"], ["apply-merges"], ["narrate"], ["info"], ["search", "alice"], ["query", "Alice Smith", "--depth", "2"], ["topology"], ["export", "csv"], ["view", "--top", "3"], ["domains"]):
        assert cli.main([*command, *([] if command == ["domains"] else ["-o", out])], spark) == 0, command
    said = capsys.readouterr().out
    path = f"{out}/relation_review.yaml"
    pipeline.run_build(spark, out, review_threshold=1.0)
    before = tables.reviews(spark, path)
    assert before.count()
    tables.save_yaml(before.withColumn("status", F.lit("REJECTED")), "relations", path)
    pipeline.run_build(spark, out, review_threshold=1.0)  # keeps what was decided
    assert {r.status for r in tables.reviews(spark, path).collect()} == {"REJECTED"}
    assert "person:alice_smith" in said and "Alice Smith" in open(f"{out}/narrative.md").read()
    assert cli.main(["query", "Nobody At All", "-o", out], spark) == 1
    assert cli.main(["build", "-o", str(tmp_path / "none")], spark) == 1


def test_stream(spark, tmp_path):
    from loomgraph.sources.domains import bundled
    from loomgraph.streaming.extraction import extract_stream

    spark.createDataFrame([(1, "Then Alice Smith met Bob Jones."), (2, "")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    extract_stream(stream, bundled("general"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == 2
