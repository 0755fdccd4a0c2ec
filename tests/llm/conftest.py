import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("label", T.StringType()), ("rank", T.LongType()), ("n", T.LongType()), ("node", T.StringType()))])


def odd_texts():
    long = " ".join(f"word{i * 7919 % 5003}" for i in range(6000))
    near = " ".join(f"near{i}" for i in range(80))
    very_long = " ".join(f"long{i * 31 % 9973}" for i in range(30000))
    key = "AK" + "IA" + "ABCDEFGHIJKLMNOPQRST"
    return [
        None, "", " ", "\n\n", "one", "two words", "same text here again and again", "same text here again and again",
        "A" * 9000 + " tail", "ab1" * 4000, " " * 6000 + "x", "é" * 3000, long, near, near + " extra", near.replace("near40", "other"), near.upper(),
        "All Rights reserved. CC BY general public license, all rights reserved", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.",
        'token = "0123456789abcdef0123456789abcdef01234567" and ' + key, "Password: hunter22 secret=abc, API_KEY : 'zzzzzzzz' ſecret=longsecret1",
        "client_id = svc-main\nx\nclient_id = svc-main value Zx9kQ2mLw8Tr4Vb7Yn3C https://api.example.org/v1",
        "the quick <|endoftext|> brown", "x  y   z\tq \r\n w", "naïve café İstanbul     end ", "\U0001f600 emoji \U0001f680", "½ ² 50", "Ⅷ", very_long, "ab1" * 40000, "tail tail tail\n",
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, odd texts, repeated rows and clashing extra columns."""
    rows = [(i * 3, t, "en" if i % 3 else None, "src", len(t) if t is not None else None, "x", i, i, "y") for i, t in enumerate(odd_texts())]
    rows += [rows[6], rows[13]]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


SF = "/root/testdata/sf0.001"


def table_dir(df, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    df.write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="session")
def odd_dir(odd, tmp_path_factory):
    return table_dir(odd, tmp_path_factory)


@pytest.fixture(scope="session")
def empty_dir(empty, tmp_path_factory):
    return table_dir(empty, tmp_path_factory)


@pytest.fixture(scope="session")
def rows_of(spark):
    return lambda d: [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session", params=["sf", "odd"])
def docs_dir(request, odd_dir):
    return SF if request.param == "sf" else odd_dir
