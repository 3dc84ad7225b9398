"""Trades of one name and entry date that repeat."""

from barloom.operators import book


def test_repeated_trades_of_a_name_leave_room_for_others(spark):
    data = [("c", "A", 1, 5, 9.0 - i) for i in range(6)] + [("c", "B", 1, 4, 1.0), ("c", "C", 1, 4, 0.5)]
    df = spark.createDataFrame(data, "cell string, code string, entry long, exit long, grad double")
    assert sorted((r["code"], r["exit"]) for r in book.slot_portfolio(df, ["cell"], 2).collect()) == [("A", 5), ("B", 4)]
