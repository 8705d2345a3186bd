import duckdb

from lorewright.llm import p3_boilerplate as P


def table(spark):
    rows = [(i, "s1", f"Texto propio {chr(97 + i)}{chr(97 + i * 2)}.\nCompártelo — ¡ya! {i}\n\nAviso legal\n123") for i in range(10)]
    rows += [(20, "s1", None), (21, "s1", ""), (22, "s2", "Aviso legal"), (23, None, "Aviso legal"), (24, "s1", "AVISO, LEGAL.\nAviso legal")] + [(30 + i, None, "Pie de página") for i in range(5)]
    return spark.createDataFrame([(*r, 1) for r in rows], "row_id bigint, source string, text string, held int")


def test_lines_blocks_and_clean(spark):
    df = table(spark)
    got = {(r["row_id"], r["line_no"]) for r in P.boilerplate_lines(df).collect()}
    wanted = {(i, n) for i in range(10) for n in (2, 4)} | {(24, 1), (24, 2)} | {(30 + i, 1) for i in range(5)}
    assert got == wanted
    blocks = P.boilerplate_blocks(df).collect()
    # A blank line parts the share prompt from the notice.
    assert len({(r["_source"], r["block"]) for r in blocks}) == 3 and len(blocks) == 3
    clean = {r["row_id"]: r["clean"] for r in P.remove_boilerplate(df).collect()}
    assert len(clean) == df.count() and clean[20] is None and clean[21] == "" and clean[0] == "Texto propio aa.\n\n123" and clean[24] == "" and clean[22] == "Aviso legal"
    assert P.boilerplate_lines(df.where("false")).count() == 0


def test_shares_need_all_rows_of_the_source(spark):
    rows = [(i, "s", "Línea común\nx" + "abcdefghij"[i % 10] * (i + 2)) for i in range(5)] + [(i, "s", None) for i in range(5, 126)]
    df = spark.createDataFrame(rows, "row_id bigint, source string, text string")
    assert P.boilerplate_lines(df).count() == 0  # 5 of 126 rows are under 4 %
    assert P.boilerplate_lines(df.where("row_id < 125")).count() == 5


def blocks_of(spark, texts):
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "row_id bigint, source string, text string")
    lines = {}
    for r in P.boilerplate_lines(df).collect():
        lines.setdefault(r["block"], set()).add(texts[r["row_id"]].split("\n")[r["line_no"] - 1])
    return sorted(map(sorted, lines.values()))


def test_edges_join_neighbours_only(spark):
    """Blocks come from the graph: a header and a footer with a text between them are two blocks, lines under each other are one."""
    body = lambda i: "\n".join(f"línea {chr(97 + i)}{chr(97 + k)}{chr(100 + i)}" for k in range(20))
    texts = [f"Cabecera\nAviso legal\n{body(i)}\nPie de página\nComparte" for i in range(12)]
    assert blocks_of(spark, texts) == [["Aviso legal", "Cabecera"], ["Comparte", "Pie de página"]]
    # An edge has to be supported itself: lines that seldom follow each other stay apart.
    loose = [f"{'Uno' if i % 2 else 'x' * (i + 1)}\n{'Dos' if i % 2 == 0 or i < 4 else 'y' * (i + 1)}\n{chr(97 + i) * 3}" for i in range(20)]
    assert blocks_of(spark, loose) == [["Dos"], ["Uno"]]


def test_small_and_large_joins_agree(spark, monkeypatch):
    df = table(spark)
    got = {tuple(r) for r in P.boilerplate_lines(df).collect()}
    clean = {tuple(r) for r in P.remove_boilerplate(df).collect()}
    from lorewright import session

    monkeypatch.setattr(session, "fits", lambda *a, **k: False)
    monkeypatch.setattr(P, "fits", lambda *a, **k: False)
    assert {tuple(r) for r in P.boilerplate_lines(df).collect()} == got and {tuple(r) for r in P.remove_boilerplate(df).collect()} == clean


def test_query_equals_sql(spark, small_tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW chapters AS SELECT * FROM read_parquet('{small_tables}/chapters.parquet')")
    assert {tuple(r) for r in P.p3_found(spark, small_tables).collect()} == set(con.execute(P.SQL["p3_found"]).fetchall())
