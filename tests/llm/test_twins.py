"""Registered queries against their SQL twins, on the small tables and on hand-made rows."""

import math

import duckdb
import pytest

from quarry.llm import registry

ODD = [
    (1, None, "en", "src1"), (2, "", None, "src1"), (3, "One two three four five\nsix\n\nsix", "en", "src2"), (4, "one two three four FIVE\nseven \t six", "en", None),
    (5, "123 !!!", "de", "src19"), (6, "Ünder über Straße\nsix", "de", "src20"), (-7, "a a b\na b b", "de", "src2"), (8, "x " * 3000, "fr", "src2"),
    (1 << 40, "ein Wort und noch ein Wort", "de", "host"), (10, "a b a\nb a a", "fr", "src2"), (11, "six", None, ""),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    more = [(100 + k, f"w{k % 9} w{k % 7} w{k % 5} w{k % 3} end\nw{k % 4} again", ["en", "de", None][k % 3], f"src{k % 4}") for k in range(150)]
    rows = [(*r, len(r[1] or ""), 7, "n") for r in ODD + more]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, line int, node string").write.parquet(f"{folder}/documents.parquet")
    def vector(k, n=64):
        return [math.sin(k * 1.7 + j * (0.3 + k % 5)) * (1 + k % 3) for j in range(n)]

    vectors = [(k, vector(k)) for k in range(120)] + [(k, vector(4)) for k in range(200, 260)] + [(k % 3, vector(9)) for k in range(6)]
    vectors += [(300, None), (350, []), (400, vector(1, 63)), (450, [None] + vector(2, 63)), (500, [float("nan")] + vector(3, 63)), (550, [float("inf")] + vector(3, 63)), (600, [0.0] * 64), (None, vector(11)), (None, vector(50)), (650, [2.0 * x for x in vector(4)])]
    spark.createDataFrame([(*r, 1, "n") for r in vectors], "vec_id long, embedding array<float>, cluster int, nodes string").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
@pytest.mark.parametrize("where", ["/root/testdata/sf0.001", "odd"])
def test_query_matches_its_twin(spark, request, name, where):
    folder = request.getfixturevalue("odd") if where == "odd" else where
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'/*.parquet' if where == 'odd' else ''}')")
    got, want = registry.queries()[name](spark, folder), con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = want.fetchall()
    columns = ", ".join(want.columns)
    assert sorted(map(repr, map(tuple, got.selectExpr(*columns.split(", ")).collect()))) == sorted(map(repr, rows))
