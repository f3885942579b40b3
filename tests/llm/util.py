"""Small tables with the hard cases every text operator has to stand."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", n_words long, kept boolean, size long, label string, TEXT string, node binary, key string, _at long"


def docs(spark, rows, clash=False):
    """Documents from (doc_id, text[, source]); `clash` adds columns named like the operators' own."""
    full = []
    for row in rows:
        doc_id, text, source = (*row, None)[:3]
        base = (doc_id, text, "en", source, len(text) if text is not None else None)
        full.append(base + ((7, True, 7, "x", "other", b"x", "k", 7) if clash else ()))
    return spark.createDataFrame(full, DOCS + (CLASH if clash else ""))


def rows(df, *columns):
    """Chosen columns as tuples, sorted with nulls first."""
    data = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(data, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


def table(folder, name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


SMALL = "/root/testdata/sf0.001"
EMPTY = [(None, None), (1, ""), (2, " \n\t "), (None, "only this"), (3, "é"), (3, "é")]
