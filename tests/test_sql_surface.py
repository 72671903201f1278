"""Functions in SQL: the same values as the Column expressions, no Python, and tables of Markdown as a table function."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import sql
from pagewright.operators import markdown
from pagewright.plans.wide import orders_markdown

SF = "/root/testdata/sf0.001"
TEXTS = ["", " ", "| a | b\\|c |", "|--|:-:|", "```x", "<!-- Page 12 -->", "<!-- 第 3 页 -->", "word-", "next", "第一", "行 一", "12%", ".5", "007", "a  b   c", "```\nx\n```", "x|y", "[t](u) **b** `c`<br/>d", "png", ".JPG", "smart", "paddle", "http://h/v1/", "1-3,7-6,99", "paragraph_title", "/a/b", "a long name of more than twenty-eight letters", "2024-05-06", "ai", "。", "x​ y　z", None]


@pytest.fixture(scope="module")
def known(spark):
    return sql.register(spark)


def sample(kind, k):
    """Values of a type, the k-th draw."""
    draw = random.Random(k)
    box = lambda: (float(draw.randrange(-5, 60)), float(draw.randrange(90)), float(draw.randrange(1, 80)), float(draw.randrange(1, 80)))
    one = {"string": lambda: TEXTS[draw.randrange(len(TEXTS))], "int": lambda: draw.choice([None, 0, 1, 3, 7, 40]), "double": lambda: draw.choice([None, -1.0, 0.0, 0.4, 0.6, 12.0, 850.0, 61234.0, 4000000.0]), "boolean": lambda: draw.random() < 0.5}
    if isinstance(kind, T.StructType):
        return box()
    if isinstance(kind, T.ArrayType):
        return [sample(kind.elementType, 100 * k + n) for n in range(draw.randrange(4))]
    if isinstance(kind, T.MapType):
        return {"a": "title", "b": "nonsense"}
    return one[kind.simpleString()]()


@pytest.mark.parametrize("name", sorted(sql.SCALARS))
def test_scalar_functions(spark, known, name):
    parameters, build = sql.SCALARS[name]
    head = re.search(rf"FUNCTION {name}\((.*)\) RETURNS ", sql.definition(spark, name))[1]
    assert head == parameters
    fields = spark.sql(f"SELECT {', '.join('CAST(NULL AS ' + p.split(' ', 1)[1] + ') AS ' + p.split(' ', 1)[0] for p in re.split(r', (?=[a-z_]+ [A-Z])(?![^<]*>)', parameters))}").schema
    rows = [tuple(sample(f.dataType, 31 * k + n) for n, f in enumerate(fields.fields)) for k in range(60)]
    if name in ("map_model_point", "pixel_to_point"):  # sides and scales are positive
        rows = [tuple(x if x is None or isinstance(x, bool) else abs(x) + 1 for x in r) for r in rows]
    table = spark.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType) for f in fields.fields]))
    table.createOrReplaceTempView("given")
    called = spark.sql(f"SELECT {name}({', '.join(fields.names)}) AS r FROM given")
    assert [r["r"] for r in called.collect()] == [r["r"] for r in table.select(build(*[F.col(c) for c in fields.names]).alias("r")).collect()]
    plan = called._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and name not in plan.replace("given", "")


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_tables_of_documents(spark, known):
    """On Markdown with fences, several tables, ragged rows and page markers, and on the corpus."""
    draw = random.Random(6)
    parts = ["| a | b |", "|---|:-:|", "| --- |", "|x|", "| 1 | 2 | 3 |", "```", "~~~", "", "text", "<!-- Page 2 -->", "<!-- 第 7 页 -->", "| e\\|f |\r", " | in | ", "|", "||", "<!-- Page x -->"]
    made = [(k, "\n".join(draw.choice(parts) for _ in range(draw.randrange(30)))) for k in range(400)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    corpus = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    orders = orders_markdown(spark, SF).select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text")
    docs.unionByName(corpus).unionByName(orders).createOrReplaceTempView("md_docs")
    want = markdown.parse_tables(spark.table("md_docs"))
    got = spark.sql("SELECT d.doc_id, t.* FROM md_docs d, LATERAL md_tables(d.text) t")
    assert got.columns == want.columns and rows_of(got) == rows_of(want) and want.count() > 300
    cells = spark.sql("SELECT d.doc_id, t.table_no, t.row_no, t.col_no, t.value FROM md_docs d, LATERAL md_tables(d.text, cells => true) t")
    assert rows_of(cells) == rows_of(markdown.cells(want))
    with pytest.raises(Exception, match="takes a text"):
        spark.sql("SELECT * FROM md_tables(5)").collect()
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT t.* FROM md_docs d, LATERAL md_tables(d.text, cells => d.doc_id > 3) t").collect()
