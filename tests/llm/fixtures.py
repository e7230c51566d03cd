"""Small tables with the awkward rows that every operator must take."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

AWKWARD = [
    None, "", " ", "\n\n", "a", "  two  spaces\tand\x0btabs \n", "▁mark ▁ inside▁", "naïve café — “quotes” ñandú ß 漢字かな交じり文 🙂🙃", "<s> </s> <|endoftext|> <unk>",
    "x" * 5000, ("word " * 3000).strip(), " nbsp em ​zero", "CRLF line\r\nnext line\r\n", "a\x00b", "don't we'll I'm 's  's", "1 22 333 4444 5,555.55", "end.\nStart of line\n\n  indented",
]


def awkward(spark, extra=()):
    texts = [*AWKWARD, *extra]
    rows = [(i, t, "en", "src0", None) for i, t in enumerate(texts)]
    rows += [(None, "null id text here", None, None, None), (3, "\n\n", "en", "src0", 2), (3, "\n\n", "en", "src0", 2)]
    return spark.createDataFrame(rows, SCHEMA), rows


def clashing(df):
    """Extra columns whose names operators are likely to use themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(i) for i, c in enumerate(["row", "n", "key", "words", "line", "score", "n_tokens", "curve", "tie", "sig", "h", "token", "part", "t_id", "trusted", "item_id", "rid", "file", "place", "quality_score", "n_lines", "n_removed", "n_pii", "pii", "_metadata"])})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
