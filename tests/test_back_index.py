from pairsim.operators import backtranslate
from pairsim.operators.position import with_position
from pairsim.schema import PAIR, TEXT_COLUMNS

TABLE = [("a b", "b a"), ("c d", "d c"), ("q", "q")]


def rows_of(df):
    return sorted((r["index"], r.id or "", r.sentence_1 or "", r.sentence_2 or "", r.label) for r in df.collect())


def indexed(spark, rows):
    df = spark.createDataFrame(rows, PAIR)
    table = spark.createDataFrame(TABLE, "text string, back_text string")
    plain = backtranslate.back_translation(df, table, ["id"])
    want = with_position(plain, ["id", *TEXT_COLUMNS], name="index")
    return rows_of(backtranslate.indexed_back_translation(df, table, ["id"], "index")), rows_of(want)


def test_rows_are_numbered_before_they_are_expanded(spark, monkeypatch):
    rows = [(f"{i:02}", "s", "a b", "c d" if i % 3 else None, 1.0, 0.0) for i in range(30)]
    rows += [(None, "s", "q", "a b", 2.0, 0.0), ("zz", None, "a b", "a b", 2.0, 0.0)]
    sorted_rows = []
    kept = backtranslate.with_position
    monkeypatch.setattr(backtranslate, "with_position", lambda df, *a, **k: sorted_rows.append(df.count()) or kept(df, *a, **k))
    got, want = indexed(spark, rows)
    assert got == want and len(got) > 4 * len(rows)
    assert sorted_rows == [len(rows)]


def test_rows_that_share_an_id(spark):
    got, want = indexed(spark, [("1", "s", "a b", "c d", 1.0, 0.0), ("1", "s", "c d", "q", 1.0, 0.0), ("1", "s", "a b", "c d", 1.0, 0.0)])
    assert got == want


def test_positions_of_rows_that_stand_for_several(spark):
    df = spark.range(100).selectExpr("id", "cast(id % 4 + 1 as int) as n")
    got = {r.id: r.pos for r in with_position(df, ["id"], partitions=7, times="n").collect()}
    assert got == {i: sum(j % 4 + 1 for j in range(i)) for i in range(100)}


def test_indexed_files_are_compressed(spark, tmp_path):
    from pairsim.sources import pairs as io

    df = spark.createDataFrame([("1", "s", 'a "b"\nc', "d", 1.0, 0.0), ("2", None, "e", "f", 2.0, 0.0)], PAIR)
    io.write_indexed(df, str(tmp_path / "out"), ["id"])
    files = [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert files and all(x.endswith(".csv.gz") for x in files)
    got = io.read_indexed(spark, str(tmp_path / "out"), PAIR).collect()
    assert sorted((r["index"], r.id, r.sentence_1) for r in got) == [(0, "1", 'a "b"\nc'), (1, "2", "e")]
