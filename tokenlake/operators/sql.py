"""Scans as table functions, for use from SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .lexer import Lexer


def register(spark: SparkSession, name: str, lexer: Lexer) -> None:
    """Makes `SELECT ... FROM t, LATERAL name(t.text)` give the rows (seq, kind, start, length, lexeme) of each text's tokens."""

    class Tokens:
        def eval(self, text):
            data = text.encode() if isinstance(text, str) else bytes(text or b"")
            at = 0
            for seq, (kind, n) in enumerate(lexer.scan(data)[0]):
                yield seq, kind, at, n, data[at : at + n]
                at += n

    spark.udtf.register(name, udtf(Tokens, returnType="seq bigint, kind bigint, start bigint, length bigint, lexeme binary"))
