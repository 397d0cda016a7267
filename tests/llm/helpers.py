"""Small tables for the tests of the training-data operators."""

import glob
import os

import duckdb

ODD_TEXTS = [None, "", " \n\t ", "word", "two words", "three small words", "a b a b a b a b a b a b", "x" * 3000, "Ünïcödé ß İ Σ ΑΣ 漢字 😀 é", "a<|endoftext|>b <|startoftext|>", "line\nline\nline\n\n", "\x00\x01 control"]


def frame(spark, rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
    return spark.createDataFrame(rows, schema)


def odd_documents(spark):
    """Odd texts, a repeated row, a null id, and extra columns whose names clash with added ones."""
    rows = [(k, t, "en" if k % 2 else None, "s" if k % 3 else None, len(t or ""), "own", 5.0) for k, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], (None, "no id here", "en", "s", 10, "own", 5.0)]
    return frame(spark, rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string, score double")


def oracle(sql: str, folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con.execute(sql).df()


def same_rows(spark_df, frame_) -> bool:
    cols = sorted(spark_df.columns)
    assert cols == sorted(frame_.columns)
    key = lambda rows: sorted([tuple(map(str, r)) for r in rows])
    return key(spark_df.select(*cols).toPandas().itertuples(index=False)) == key(frame_[cols].itertuples(index=False))
