"""SQL names for the engine's functions and relations."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Table functions html_nodes, html_headings, document_text and scalar node_text, to_markdown for spark.sql."""
    from pyspark.sql import functions as F

    from docframe.operators import dom, markdown
    from docframe.sources import containers, documents

    class Nodes:
        def eval(self, html: str):
            yield from dom.node_rows(html or "")

    class Headings:
        def eval(self, html: str):
            yield from dom.headings(dom.parse(html or ""))

    class Outline:
        def eval(self, content: bytes):
            yield from documents._book(bytes(content or b"")).toc()

    spark.udtf.register("html_nodes", F.udtf(Nodes, returnType=dom.NODES))
    spark.udtf.register("html_headings", F.udtf(Headings, returnType="level int, title string, fragment string"))
    spark.udtf.register("document_outline", F.udtf(Outline, returnType="level int, title string, part string, fragment string"))
    spark.udf.register("node_text", F.pandas_udf(lambda s: s.map(lambda m: dom.node_text(dom.parse(m or ""))), "string"))
    spark.udf.register("to_markdown", F.pandas_udf(lambda s: s.map(lambda m: markdown.to_markdown(m or "")), "string"))
    spark.udf.register("document_text", F.pandas_udf(lambda s: s.map(lambda b: containers.text_of(documents._book(bytes(b or b"")))), "string"))
