"""Small documents with every awkward case the operators must define."""
import duckdb
import pandas as pd

LONG = " ".join(f"word{i % 977} item{i % 31}" for i in range(30_000))

EDGE = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the quiet house.", "en", "src0"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the quiet house.", "en", "src0"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the quiet house.", "en", "src0"),
    (3, None, "en", "src1"),
    (4, "", None, None),
    (5, " \t\r\n\x0b\x0c ", "en", "src2"),
    (None, "a text whose id is null, with some words in it", "en", "src3"),
    (None, None, None, None),
    (6, "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich und zurück", "de", "other"),
    (7, LONG, "en", "src0"),
    (8, "one", "en", "src0"),
    (9, "Ünïcödé \U0001F600 слово λέξη 語   nbsp em", "en", "src5"),
    (10, "### $$$ %%% &&& *** ||| <<< >>>", "en", "src5"),
    (11, "same same same same same same same same same same same same same same same same same same same same same", "en", "src6"),
]


def edge_frame(spark, rows=EDGE):
    """With extra columns whose names the operators use inside."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, fp long, row_key long, shard int, "
              "copy int, link long, word string, score double, rid long")
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 3, 4, 5, "x", 0.5, 7) for r in rows], schema)


def plain(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def empty(spark):
    return edge_frame(spark).limit(0)


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.execute(sql).df()


def same_rows(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    cols = sorted(a.columns)
    assert cols == sorted(b.columns), (cols, sorted(b.columns))

    def norm(v):
        if pd.isna(v):
            return "null"
        return f"{v:.6f}" if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, (float, int)) else str(v)

    rows = lambda d: sorted(tuple(norm(v) for v in r) for r in d[cols].astype(object).itertuples(index=False))
    assert rows(a) == rows(b), [x for x in zip(rows(a), rows(b)) if x[0] != x[1]][:3]
    return True
