"""Small tables with the cases every operator has to stand."""

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, source="s", extra=False):
    rows = [(i, t, "en", source if isinstance(source, str) or source is None else source[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    return df.selectExpr("*", "'x' AS size", "1 AS bucket", "'y' AS spans", "0.5 AS score", "'q' AS key", "1 AS h") if extra else df


ODD = [None, "", " \n\t ", "one", "a b c", "ü é ñ 漢字 😀", "same text here to repeat", "same text here to repeat", "x" * 3000, "word " * 20000]


def odd_frame(spark, extra=True):
    """Nulls in any column, empty and long texts, ties, repeated rows and columns with clashing names."""
    base = docs_frame(spark, ODD, extra=extra)
    more = spark.createDataFrame([(None, None, None, None, None), (3, "one", "en", "s", 3), (77, "text without source", None, None, None)], DOC)
    for c in base.columns[5:]:
        more = more.withColumn(c, base.schema[c].dataType and __import__("pyspark").sql.functions.lit(None).cast(base.schema[c].dataType))
    return base.unionByName(more)
