"""How large a table is, which decides whether it is broadcast."""

from wickwork.llm.shared import ROW_BYTES, size_of


def test_size_counts_what_is_inside(spark):
    schema = "id long, s string, t struct<a:string,b:struct<c:binary>>, l array<string>, m map<string,array<string>>, n array<int>"
    rows = [
        (1, "x" * 100, ("y" * 200, (b"z" * 300,)), ["a" * 400, None, "b" * 50], {"k" * 10: ["v" * 500]}, [1, 2, 3]),
        (2, None, None, None, None, None),
        (3, "é", (None, (None,)), [], {}, []),
    ]
    got = size_of(spark.createDataFrame(rows, schema))
    content = 100 + 200 + 300 + 450 + 10 + 500 + 2
    assert content + 3 * ROW_BYTES < got < content + 3 * ROW_BYTES + 600
    assert size_of(spark.createDataFrame([], schema)) == 0


def test_long_ids_in_structs_are_not_small(spark):
    df = spark.range(100).selectExpr("struct(repeat('i', 5000) AS id, repeat('d', 64) AS digest) AS leader", "array(struct(repeat('x', 1000) AS y)) AS l")
    assert size_of(df) > 100 * 6064
