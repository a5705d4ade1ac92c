"""The radius at which runs of folds are unique, from one row a page."""

from lectern.operators import layout


def test_unique_radius_copies_no_row(spark):
    pages = {"a": "a b c d", "b": "a b a b a", "c": "x a b y a b z", "d": "q", "e": "a " * 20}
    df = spark.createDataFrame([(p, i, f) for p, x in pages.items() for i, f in enumerate(x.split())], "page_id string, seq int, f string")
    out = layout.unique_radius(df)

    def plain(f):
        for k in range(1, 5):
            if len({tuple(f[j] if 0 <= j < len(f) else "" for j in range(i - k, i + k + 1)) for i in range(len(f))}) == len(f):
                return k

    assert {r.page_id: r.radius for r in out.collect()} == {p: plain(x.split()) for p, x in pages.items()}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
