"""Running heads and feet on literal pages."""

from tessera.sources.edges import page_edges


def test_edges(spark):
    page = lambda n: ["  Annual  report 20%d " % n, "", "Chapter", "same body line", "body", "Q%d." % n, None, "Page %d of 9" % n]
    lines = [("a", n, k, t) for n in (1, 2, 3) for k, t in enumerate(page(n))]
    lines += [("b", n, k, t) for n in (1, 2) for k, t in enumerate(page(n))] + [(None, n, 0, "only line") for n in (1, 2, 3)] + [("c", n, 0, "x" * 61) for n in range(4)] + [("c", 9, 0, "– 12 –")]
    got = {(r["doc"], r["page"], r["pos"]): r["kind"] for r in page_edges(spark.createDataFrame(lines, "doc string, page int, pos int, text string")).collect()}
    want = {(d, n, 7): "page_number" for d, ns in (("a", (1, 2, 3)), ("b", (1, 2))) for n in ns} | {("c", 9, 0): "page_number"}
    want |= {("a", n, k): "header" for n in (2, 3) for k in (0, 2)} | {(None, n, 0): "header" for n in (2, 3)}
    assert got == want
    assert page_edges(spark.createDataFrame([], "doc string, page int, pos int, text string")).count() == 0
