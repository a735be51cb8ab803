"""The registered queries: each over its whole tables, with DuckDB SQL beside it where SQL can say the same."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import Charset, choice, concat, kleene, plus, text
from ..functions.pattern import any_of
from ..functions.rawstring import scan_raw_string
from ..functions.unicode import byte_ranges, code_points, xid_continue, xid_start
from ..operators import carry, dot, native, recovery, relations, scan, sql
from ..operators.automaton import Nfa
from ..operators.lexer import Lexer
from ..operators.modes import ModalTokenSet, go_to, pop, push
from ..operators.tokenset import TokenSet
from . import grammars, stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: SQL, or what makes it.
ORACLES: dict[str, str | Callable[[], str]] = {}


def query(oracle: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(rows: list[tuple]) -> str:
    """Rows as an SQL VALUES list."""
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


# Tokens of tables. SQL finds the same tokens with regular expressions whose first match is always the longest.

_WORDS = r"[A-Za-z_][A-Za-z_0-9]*|[0-9]+|[ \t\n\r]+|(?s:.)"
_WORD_KIND = r"CASE WHEN regexp_full_match(lex, '[A-Za-z_][A-Za-z_0-9]*') THEN 0 WHEN regexp_full_match(lex, '[0-9]+') THEN 1 WHEN regexp_full_match(lex, '[ \t\n\r]+') THEN 2 ELSE 3 END"
_WORD_TOKENS = f"""t AS (SELECT doc_id, lex, ({_WORD_KIND})::BIGINT AS kind, strlen(lex)::BIGINT AS length, i AS seq
  FROM (SELECT doc_id, unnest(x) AS lex, unnest(range(len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_WORDS}') AS x FROM documents)))"""


@query(f"WITH {_WORD_TOKENS} SELECT kind, count(*) AS tokens, sum(length)::BIGINT AS bytes FROM t GROUP BY kind")
def token_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: tokens and bytes of each kind over all documents."""
    return scan.totals(table(spark, sf_dir, "documents"), grammars.lexer("words"))


@query(f"WITH {_WORD_TOKENS} SELECT doc_id, count(*) AS tokens, sum(length)::BIGINT AS bytes, count(DISTINCT kind) AS kinds, max(length) AS longest FROM t GROUP BY doc_id")
def token_stream_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = native.lexemes(table(spark, sf_dir, "documents"), grammars.lexer("words"))
    return tokens.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum("length").alias("bytes"), F.size(F.collect_set("kind")).cast("long").alias("kinds"), F.max("length").alias("longest"))


@query(f"WITH {_WORD_TOKENS} SELECT doc_id, kind AS token, length FROM t WHERE seq = 0")
def first_token_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.first_tokens(table(spark, sf_dir, "documents"), grammars.lexer("words")).select("doc_id", "token.*")


@query(f"WITH {_WORD_TOKENS} SELECT doc_id, sum(CASE kind WHEN 0 THEN 7 WHEN 1 THEN 9000000000 ELSE 0 END)::BIGINT AS payload FROM t GROUP BY doc_id")
def tokens_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = grammars.words().set_token_payload(grammars.WORD, 1).set_token_payload(grammars.WORD, 7).set_token_payload(grammars.DIGITS, 9_000_000_000)
    return scan.tokenize(table(spark, sf_dir, "documents"), own.compile(), payload=True).groupBy("doc_id").agg(F.sum("payload").alias("payload"))


@query(f"WITH {_WORD_TOKENS}, f AS (SELECT doc_id, min(seq) AS stop FROM t WHERE kind = 1 GROUP BY doc_id) SELECT doc_id, count(*) AS tokens, sum(length)::BIGINT AS bytes FROM t LEFT JOIN f USING (doc_id) WHERE stop IS NULL OR seq <= stop GROUP BY doc_id")
def tokens_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens up to each document's first number."""
    return stats.tally(scan.tokenize(table(spark, sf_dir, "documents"), grammars.lexer("words"), stop=frozenset({grammars.DIGITS})), "doc_id")


@query(f"WITH {_WORD_TOKENS} SELECT doc_id, count(*) AS tokens FROM t WHERE kind <> 2 GROUP BY doc_id")
def tokens_without_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = scan.tokenize(table(spark, sf_dir, "documents"), grammars.lexer("words"))
    return tokens.where(F.col("kind") != grammars.BLANK).groupBy("doc_id").agg(F.count("*").alias("tokens"))


@query(f"WITH {_WORD_TOKENS} SELECT lower(lex) AS word, count(*) AS n FROM t WHERE kind = 0 GROUP BY 1")
def word_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexemes of words, lower-cased, with their frequencies."""
    tokens = native.lexemes(table(spark, sf_dir, "documents"), grammars.lexer("words")).where("kind = 0")
    return tokens.groupBy(F.lower("lexeme").alias("word")).agg(F.count("*").alias("n"))


@query(f"WITH {_WORD_TOKENS} SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list(kind + 1 ORDER BY seq)), lambda h, k: (h * 31 + k) % 1000000007) AS checksum FROM t GROUP BY doc_id")
def token_order_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.order_checksum(scan.tokenize(table(spark, sf_dir, "documents"), grammars.lexer("words")), "doc_id")


@query(f"WITH {_WORD_TOKENS} SELECT coalesce(lang, '*') AS lang, coalesce(kind, -1) AS kind, count(*) AS tokens FROM t JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, kind)")
def token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = scan.totals(docs, grammars.lexer("words"), ("lang",))
    rolled = counts.rollup("lang", "kind").agg(F.sum("tokens").alias("tokens"))
    return rolled.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("kind", F.lit(-1)).cast("long").alias("kind"), "tokens")


@query(f"""WITH {_WORD_TOKENS}, n AS (SELECT lang, sum((kind = 1)::INT)::DOUBLE AS s, count(*)::DOUBLE AS n FROM t JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, round((s / n + 3.8416 / (2 * n) - 1.96 * sqrt(s / n * (1 - s / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 9) AS low,
  round((s / n + 3.8416 / (2 * n) + 1.96 * sqrt(s / n * (1 - s / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 9) AS high FROM n""")
def number_share_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilson intervals of the share of numbers among tokens, by language."""
    docs = table(spark, sf_dir, "documents")
    counts = scan.totals(docs, grammars.lexer("words"), ("lang",))
    n = counts.groupBy("lang").agg(F.sum(F.when(F.col("kind") == grammars.DIGITS, F.col("tokens")).otherwise(0)).alias("s"), F.sum("tokens").alias("n"))
    low, high = recovery.wilson(F.col("s"), F.col("n"))
    return n.select("lang", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(r"""SELECT kind::BIGINT AS kind, count(*) AS tokens, sum(strlen(lex))::BIGINT AS bytes FROM (
  SELECT lex, CASE WHEN lex IN ('STANDARD', 'PROMO', 'ECONOMY') THEN 1 WHEN regexp_full_match(lex, '[A-Za-z_][A-Za-z_0-9]*') THEN 0 ELSE 2 END AS kind
  FROM (SELECT unnest(regexp_extract_all(p_type, '[A-Za-z_][A-Za-z_0-9]*|(?s:.)')) AS lex FROM part)) GROUP BY 1""")
def keyword_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords win over identifiers of the same length by priority."""
    own = TokenSet().add_token(grammars.identifier(), 0, 2).add_token(choice(text("STANDARD"), text("PROMO"), text("ECONOMY")), 1, 1).add_token(code_points(0, 0x10FFFF), 2, 9)
    return stats.tally(scan.tokenize(table(spark, sf_dir, "part"), own.compile(), "p_partkey", "p_type"), "kind")


_TAGS = r"</|<!--|<!|<|[^<]+"


@query(rf"""SELECT (CASE lex WHEN '<' THEN 0 WHEN '</' THEN 1 WHEN '<!' THEN 2 WHEN '<!--' THEN 3 ELSE 4 END)::BIGINT AS kind, count(*) AS tokens, sum(strlen(lex))::BIGINT AS bytes
FROM (SELECT unnest(regexp_extract_all(html, '{_TAGS}')) AS lex FROM pages) GROUP BY 1""")
def longest_beats_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`<` has the best priority, and still the longer marks win."""
    own = TokenSet().add_token(text("<"), 0, 0).add_token(text("</"), 1, 5).add_token(text("<!"), 2, 6).add_token(text("<!--"), 3, 7).add_token(plus(any_of(Charset.all() - "<")), 4, 8)
    return stats.tally(scan.tokenize(table(spark, sf_dir, "pages"), own.compile(), "page_id", "html"), "kind")


@query(r"""SELECT kind::BIGINT AS kind, count(*) AS tokens FROM (SELECT CASE WHEN regexp_full_match(lex, '[A-Z]+') THEN 3 WHEN regexp_full_match(lex, '[A-Za-z]+') THEN 5 ELSE 6 END AS kind
  FROM (SELECT unnest(regexp_extract_all(o_orderpriority, '[A-Za-z]+|(?s:.)')) AS lex FROM orders)) GROUP BY 1""")
def equal_priority_tie_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At equal length and priority the lower id wins."""
    own = TokenSet().add_token(plus(any_of(Charset.alpha())), 5, 1).add_token(plus(any_of(Charset.range("A", "Z"))), 3, 1).add_token(any_of(Charset.all()), 6, 9)
    return scan.tokenize(table(spark, sf_dir, "orders"), own.compile(), "o_orderkey", "o_orderpriority").groupBy("kind").agg(F.count("*").alias("tokens"))


_JSON = r'"(?:[^"\\]|\\.)*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|[{}\[\]:,]|[ \t\n\r]+'


@query(rf"""SELECT (CASE WHEN lex[1] = '"' THEN 0 WHEN regexp_matches(lex, '^[-0-9]') THEN 1 WHEN lex IN ('true', 'false', 'null') THEN 2 WHEN regexp_matches(lex, '^[ \t\n\r]') THEN 4 ELSE 3 END)::BIGINT AS kind,
  count(*) AS tokens, sum(strlen(lex))::BIGINT AS bytes FROM (SELECT unnest(regexp_extract_all(props, '{_JSON}')) AS lex FROM events) GROUP BY 1""")
def json_tokens_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tally(scan.tokenize(table(spark, sf_dir, "events"), grammars.lexer("JSON"), "event_id", "props"), "kind")


@query(r"""SELECT (CASE WHEN lex[1:2] = '</' THEN 0 WHEN lex[1:2] = '<!' THEN 1 WHEN lex = '<' THEN 4 WHEN lex[1] = '<' THEN 2 ELSE 3 END)::BIGINT AS kind, count(*) AS tokens, sum(strlen(lex))::BIGINT AS bytes
FROM (SELECT unnest(regexp_extract_all(html, '<[^>]*>|[^<]+|<')) AS lex FROM pages) GROUP BY 1""")
def html_tokens_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.totals(table(spark, sf_dir, "pages"), grammars.lexer("html"), data="html")


@query(r"SELECT doc_id, count(*) FILTER (WHERE lex <> chr(10)) AS lines, count(*) FILTER (WHERE lex = chr(10)) AS ends, max(strlen(lex))::BIGINT AS longest FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]+|\n')) AS lex FROM documents) GROUP BY 1")
def log_line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = native.lexemes(table(spark, sf_dir, "documents"), grammars.lexer("log lines"))
    return tokens.groupBy("doc_id").agg(F.count(F.when(F.col("kind") == 0, 1)).alias("lines"), F.count(F.when(F.col("kind") == 1, 1)).alias("ends"), F.max("length").alias("longest"))


@query(r"""SELECT (CASE WHEN regexp_full_match(lex, '[A-Za-z_\x{C0}-\x{24F}][0-9A-Za-z_\x{C0}-\x{24F}]*') THEN 0 ELSE 1 END)::BIGINT AS kind, count(*) AS tokens, sum(strlen(lex))::BIGINT AS bytes
FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z_\x{C0}-\x{24F}][0-9A-Za-z_\x{C0}-\x{24F}]*|(?s:.)')) AS lex FROM documents) GROUP BY 1""")
def utf8_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = choice(any_of(Charset.alpha() + "_"), code_points(0xC0, 0x24F))
    own = TokenSet().add_token(concat(letters, kleene(choice(letters, any_of(Charset.digits())))), 0, 1).add_token(code_points(0, 0x10FFFF), 1, 9)
    return stats.tally(scan.tokenize(table(spark, sf_dir, "documents"), own.compile()), "kind")


@query(r"""SELECT (CASE WHEN regexp_full_match(lex, '[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*') THEN 0 ELSE 1 END)::BIGINT AS kind, count(*) AS tokens, sum(strlen(lex))::BIGINT AS bytes
FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*|(?s:.)')) AS lex FROM documents) GROUP BY 1""")
def xid_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of UAX #31 over all documents; SQL spells the properties by general categories, which differ in rare characters only."""
    own = TokenSet().add_token(concat(choice(xid_start(), text("_")), kleene(xid_continue())), 0, 1).add_token(code_points(0, 0x10FFFF), 1, 9)
    return scan.totals(table(spark, sf_dir, "documents"), own.compile())


@query(r"""SELECT item_id, count(*) AS tokens, count(DISTINCT lower(lex)) FILTER (WHERE regexp_full_match(lex, '[A-Za-z_][A-Za-z_0-9]*')) AS words
FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z_0-9]*|[0-9]+|[ \t\n\r]+|(?s:.)')) AS lex FROM benchmark) GROUP BY 1""")
def sql_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan as a table function, called from SQL."""
    sql.register(spark, "word_tokens", grammars.lexer("words"))
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("tokenlake_benchmark")
    return spark.sql(
        "SELECT item_id, count(*) AS tokens, count(DISTINCT CASE WHEN kind = 0 THEN lower(cast(lexeme AS STRING)) END) AS words FROM tokenlake_benchmark, LATERAL word_tokens(text) GROUP BY item_id"
    )


# Pattern algebra.

_SETS = {"digits": "[0-9]", "alpha": "[A-Za-z]", "alphanum": "[A-Za-z0-9]", "printable": "[ -~]", "escape": "[\\n\\t\\r''\"\\\\]", "newline": "[\\n\\r]", "whitespace": "[ \\t]", "alpha - vowels": "[B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]", "digits + dot": "[0-9.]"}


@query("WITH b AS (SELECT range AS byte FROM range(128)) SELECT name, byte::INT AS byte FROM b, (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _SETS.items()) + ") s(name, pattern) WHERE regexp_full_match(chr(byte::INT), pattern) AND byte > 0")
def charset_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {n: getattr(Charset, n)() for n in ("digits", "alpha", "alphanum", "printable", "escape", "newline", "whitespace")}
    made |= {"alpha - vowels": Charset.alpha() - Charset.of("aeiouAEIOU"), "digits + dot": Charset.digits() + "."}
    rows = spark.createDataFrame([(n, s.symbols()) for n, s in made.items()], "name string, bytes array<int>")
    return rows.select("name", F.explode("bytes").alias("byte"))


@query("SELECT c AS ch, strlen(c)::BIGINT AS length, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE strlen(c) > 1 GROUP BY c")
def utf8_range_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points beyond ASCII, each one token of its own by the byte ranges that spell them."""
    own = TokenSet().add_token(code_points(0x80, 0x10FFFF), 1).add_token(plus(any_of(Charset.range(0, 0x7F))), 0)
    tokens = scan.tokenize(table(spark, sf_dir, "documents"), own.compile(), lexemes=True).where("kind = 1")
    return tokens.groupBy(F.col("lexeme").cast("string").alias("ch"), "length").agg(F.count("*").alias("n"))


_RANGE = (0x7F0, 0x11000)


@query(f"SELECT (CASE WHEN c < 128 THEN 1 WHEN c < 2048 THEN 2 WHEN c < 65536 THEN 3 ELSE 4 END)::BIGINT AS length, count(*) AS code_points FROM range({_RANGE[0]}, {_RANGE[1] + 1}) r(c) WHERE c NOT BETWEEN 55296 AND 57343 GROUP BY 1")
def utf8_range_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points that the byte ranges of U+07F0..U+11000 spell, by length."""
    rows = [(i, a, b) for i, s in enumerate(byte_ranges(*_RANGE)) for a, b in s]
    each = spark.createDataFrame(rows, "seq int, first int, last int").groupBy("seq").agg(F.count("*").alias("length"), F.product(F.col("last") - F.col("first") + 1).cast("long").alias("n"))
    return each.groupBy("length").agg(F.sum("n").alias("code_points"))


# Automata as relations.

_AUTOMATA = ("base", "base + strings", "base + block comments", "JSON", "log lines", "conventional", "split-friendly", "scaling")


def _lexers() -> dict[str, Lexer]:
    return {g: grammars.lexer(g) for g in _AUTOMATA}


def _nfas() -> dict[str, Nfa]:
    own = {"identifier": grammars.identifier(), "float": grammars.decimal_float(), "keywords": choice(text("if"), text("in"), text("int"))}
    return {g: Nfa().add(p, 1, 0) for g, p in own.items()}


def _delta_sql(lexers: dict[str, Lexer]) -> str:
    d = values([(g, *r) for g, x in lexers.items() for r in x.dfa.rows()])
    a = values([(g, s, int(t), int(t) in x.ignored) for g, x in lexers.items() for s, t in enumerate(x.dfa.accept) if t >= 0])
    return f"""delta(grammar, state, byte, next) AS (VALUES {d}), acc(grammar, state, token_id, ignored) AS (VALUES {a}),
reached AS (SELECT DISTINCT grammar, 0 AS state FROM delta UNION SELECT d.grammar, d.next FROM reached r JOIN delta d ON d.grammar = r.grammar AND d.state = r.state),
able AS (SELECT grammar, state FROM acc UNION SELECT d.grammar, d.state FROM able r JOIN delta d ON d.grammar = r.grammar AND d.next = r.state)"""


def _relations(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    x = _lexers()
    return relations.cut(relations.delta(spark, x)), relations.cut(relations.accept(spark, x)), relations.cut(relations.starts(spark, x))


def _nfa_sql() -> str:
    rows = values([(g, *r) for g, n in _nfas().items() for r in n.rows()])
    return f"""WITH RECURSIVE e(grammar, src, sym, dst) AS (VALUES {rows}), s AS (SELECT DISTINCT grammar, src AS state FROM e UNION SELECT grammar, dst FROM e),
c AS (SELECT grammar, state, state AS member FROM s UNION SELECT c.grammar, c.state, e.dst FROM c JOIN e ON e.grammar = c.grammar AND e.src = c.member AND e.sym IS NULL)
SELECT grammar, state::INT AS state, member::INT AS member FROM c"""


@query(_nfa_sql)
def nfa_epsilon_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.epsilon_closure(relations.nfa_edges(spark, _nfas()))


@query(lambda: f"WITH RECURSIVE {_delta_sql(_lexers())} SELECT grammar, state::INT AS state FROM reached")
def dfa_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, _, s = _relations(spark)
    return relations.reachable(d, s)


@query(lambda: f"WITH RECURSIVE {_delta_sql(_lexers())} SELECT grammar, state::INT AS state FROM able")
def dfa_coaccessible(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, a, _ = _relations(spark)
    return relations.leading_to(d, a).select("grammar", F.col("state"))


@query(lambda: f"WITH RECURSIVE {_delta_sql(_lexers())} SELECT grammar, state::INT AS state FROM able INTERSECT SELECT grammar, state::INT FROM reached")
def dfa_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.live(*_relations(spark))


@query(lambda: f"""WITH RECURSIVE {_delta_sql(_lexers())}, sig AS (SELECT grammar, byte, list(state * 100000 + next ORDER BY state) AS s FROM delta GROUP BY 1, 2), low AS (SELECT grammar, s, min(byte) AS b FROM sig GROUP BY 1, 2)
SELECT sig.grammar, sig.byte::INT AS byte, (SELECT count(*) FROM low x WHERE x.grammar = sig.grammar AND x.b < low.b)::BIGINT AS class FROM sig JOIN low ON low.grammar = sig.grammar AND low.s = sig.s""")
def symbol_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.symbol_classes(_relations(spark)[0])


_SPLIT = """useful AS (SELECT d.* FROM delta d JOIN able a ON a.grammar = d.grammar AND a.state = d.next JOIN reached r ON r.grammar = d.grammar AND r.state = d.state),
again AS (SELECT DISTINCT d.grammar FROM delta d JOIN reached r ON r.grammar = d.grammar AND r.state = d.state WHERE d.next = 0),
kept AS (SELECT grammar, state FROM acc WHERE NOT ignored UNION SELECT d.grammar, d.state FROM kept k JOIN delta d ON d.grammar = k.grammar AND d.next = k.state),
offends AS (SELECT * FROM useful WHERE state <> 0 OR grammar IN (SELECT grammar FROM again))"""


@query(lambda: f"WITH RECURSIVE {_delta_sql(_lexers())}, {_SPLIT} SELECT grammar, byte::INT AS byte FROM useful u WHERE state = 0 AND NOT EXISTS (SELECT 1 FROM offends o WHERE o.grammar = u.grammar AND o.byte = u.byte)")
def split_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.split_points(*_relations(spark))


@query(lambda: f"""WITH RECURSIVE {_delta_sql(_lexers())}, {_SPLIT} SELECT grammar, byte::INT AS byte FROM useful u WHERE state = 0 AND NOT EXISTS (
  SELECT 1 FROM offends o WHERE o.grammar = u.grammar AND o.byte = u.byte AND NOT (o.next = u.next AND EXISTS (SELECT 1 FROM acc WHERE acc.grammar = o.grammar AND acc.state = o.state AND acc.ignored)
    AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.grammar = o.grammar AND k.state = o.state)))""")
def split_points_ignoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.split_points(*_relations(spark), relaxed=True)


# Certified bytes, exactly and up to ignored tokens, and the length of a shortest certified window (0: none, or a byte certifies).
_CERTIFICATES = [
    ("base", 24, 27, 0), ("base + strings", 0, 1, 2), ("base + line comments", 0, 1, 2), ("base + block comments", 0, 0, 4), ("JSON", 0, 3, 2), ("log lines", 1, 1, 0), ("conventional", 0, 1, 2),
    ("split-friendly", 1, 1, 0), ("split-friendly + block comments", 0, 0, 4), ("keyword-scale", 16, 19, 0), ("scaling", 13, 16, 0),
]


@query(f"SELECT grammar, exact::BIGINT AS exact, ignoring::BIGINT AS ignoring, \"window\"::BIGINT AS \"window\" FROM (VALUES {values(_CERTIFICATES)}) t(grammar, exact, ignoring, \"window\")")
def split_point_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates of the named token sets."""
    rows = []
    for g in grammars.TABLE:
        x = grammars.lexer(g)
        exact = int(x.split_points.sum())
        found = None if exact else x.shortest_window()
        rows.append((g, exact, int(x.split_points_ignoring.sum()), len(found[0]) if found else 0))
    return spark.createDataFrame(rows, "grammar string, exact long, ignoring long, window long")


_WINDOWED = ("base + strings", "JSON", "conventional")


def _window_oracle() -> str:
    """The histories' cloud for every pair of bytes, in SQL over the transitions alone."""
    x = {g: grammars.lexer(g) for g in _WINDOWED}
    return f"""WITH RECURSIVE {_delta_sql(x)}, {_SPLIT.split("kept AS")[0].rstrip().rstrip(",")},
moves AS (SELECT d.* FROM delta d JOIN (SELECT * FROM able INTERSECT SELECT * FROM reached) l ON l.grammar = d.grammar AND l.state = d.next),
cloud0 AS (SELECT grammar, state, -1 AS origin FROM (SELECT * FROM able INTERSECT SELECT * FROM reached)),
cloud1 AS (
  SELECT m.grammar, m.byte AS b1, m.next AS state, CASE WHEN m.state = 0 AND m.grammar NOT IN (SELECT grammar FROM again) THEN 0 ELSE origin END AS origin FROM cloud0 c JOIN moves m ON m.grammar = c.grammar AND m.state = c.state
  UNION SELECT grammar, byte, next, 0 FROM moves WHERE state = 0),
cloud2 AS (
  SELECT m.grammar, b1, m.byte AS b2, m.next AS state, CASE WHEN m.state = 0 AND m.grammar NOT IN (SELECT grammar FROM again) THEN 1 ELSE origin END AS origin FROM cloud1 c JOIN moves m ON m.grammar = c.grammar AND m.state = c.state
  UNION SELECT c.grammar, c.b1, m.byte, m.next, 1 FROM cloud1 c JOIN acc a ON a.grammar = c.grammar AND a.state = c.state JOIN moves m ON m.grammar = c.grammar AND m.state = 0)
SELECT grammar, b1::INT AS first, b2::INT AS second, min(origin)::INT AS origin FROM cloud2 GROUP BY 1, 2, 3 HAVING min(origin) = max(origin) AND min(origin) >= 0"""


@query(_window_oracle)
def split_windows_len2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certified two-byte windows, by joins."""
    x = {g: grammars.lexer(g) for g in _WINDOWED}
    return relations.windows_of_two(relations.delta(spark, x), relations.accept(spark, x), relations.starts(spark, x))


@query("SELECT 120::BIGINT AS windows, 63::BIGINT AS whitespace_first")
def json_window_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grammars.lexer("JSON").certified_windows(2)
    rows = spark.createDataFrame([(w[0], w[1], o) for w, o in found.items()], "first int, second int, origin int")
    return rows.agg(F.count("*").alias("windows"), F.count(F.when(F.col("first").isin(9, 10, 13), 1)).alias("whitespace_first"))


@query("SELECT set_name, certified::BIGINT AS certified, true AS witnessed FROM (VALUES ('base + strings', 1), ('JSON', 1), ('conventional', 1)) t(set_name, certified)")
def window_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest certified window's offset, and whether an input that scans wholly holds the window."""
    rows = []
    for g in _WINDOWED:
        window, origin = grammars.lexer(g).shortest_window()
        found = grammars.lexer(g).witness(window)
        rows.append((g, origin, found is not None and window in found))
    return spark.createDataFrame(rows, "set_name string, certified long, witnessed boolean")


@query()
def grammar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the named token sets as a relation."""
    rows = [(g, *r) for g in grammars.TABLE for r in grammars.TABLE[g]().rows()]
    return spark.createDataFrame(rows, "grammar string, token_id long, priority long, pattern string, payload long, ignored boolean")


# Chunks.

_CHUNKS = 4
_PLAN = f"""d AS (SELECT doc_id, strlen(text)::BIGINT AS size, list_transform(list_filter(range(0, len(string_split(text, chr(10))) - 1), lambda i: true), lambda i: strlen(array_to_string(string_split(text, chr(10))[1 : i + 1], chr(10)))::BIGINT) AS marks FROM documents),
p AS (
  SELECT doc_id, size, marks, 0 AS i, [0::BIGINT] AS cuts FROM d
  UNION ALL
  SELECT doc_id, size, marks, i + 1, CASE WHEN x IS NULL THEN cuts ELSE list_append(cuts, x) END
  FROM (SELECT *, list_min(list_filter(marks, lambda m: m >= greatest(size * (i + 1) // least({_CHUNKS}, size), cuts[-1] + 1))) AS x FROM p WHERE i + 1 < least({_CHUNKS}, size)))"""


@query(f"WITH RECURSIVE {_PLAN}, f AS (SELECT doc_id, list_append(cuts, size) AS c FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1) SELECT doc_id, (k - 1)::INT AS chunk, c[k] AS \"begin\", c[k + 1] AS \"end\" FROM (SELECT doc_id, c, unnest(range(1, len(c))) AS k FROM f)")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks at line ends, which the set of lines certifies."""
    return scan.plan_chunks(table(spark, sf_dir, "documents"), grammars.lexer("log lines"), _CHUNKS)


def _cost_sql(density: str, byte: int | None) -> str:
    marks = "[]::BIGINT[]" if byte is None else f"list_transform(range(1, len(x)), lambda i: strlen(array_to_string(x[1:i], chr({byte})))::BIGINT)"
    split = "[]::VARCHAR[]" if byte is None else f"string_split(text, chr({byte}))"
    return f"""(WITH RECURSIVE d AS (SELECT doc_id, size, {marks} AS marks FROM (SELECT doc_id, strlen(text)::BIGINT AS size, {split} AS x FROM documents)),
p AS (
  SELECT doc_id, size, marks, 0 AS i, 0::BIGINT AS cut, 1 AS chunks, 0::BIGINT AS looked, {"true" if byte is None else "false"} AS missed FROM d
  UNION ALL
  SELECT doc_id, size, marks, i + 1, coalesce(x, cut), chunks + CASE WHEN x IS NULL THEN 0 ELSE 1 END, looked + CASE WHEN missed THEN 0 ELSE coalesce(x, size) - floor END, missed OR x IS NULL
  FROM (SELECT *, CASE WHEN missed THEN NULL ELSE list_min(list_filter(marks, lambda m: m >= floor)) END AS x FROM (SELECT *, greatest(size * (i + 1) // least({_CHUNKS}, size), cut + 1) AS floor FROM p WHERE i + 1 < least({_CHUNKS}, size))))
SELECT '{density}' AS density, doc_id, chunks::INT AS chunks, looked FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1)"""


#: How often a certified byte occurs, and which byte: in each line, in few texts, never, and none certified at all.
_DENSITIES = {"frequent": "\n", "rare": "%", "absent": "\x01", "uncertified": ""}


@query(lambda: " UNION ALL ".join(f"SELECT * FROM {_cost_sql(d, ord(by) if by else None)}" for d, by in _DENSITIES.items()))
def plan_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What plans look at as certified bytes grow scarce: of each text the chunks, and the bytes between shares and cuts."""
    docs = table(spark, sf_dir, "documents")
    costs = [scan.plan_cost(docs, grammars.separated(by).compile(), _CHUNKS).select(F.lit(d).alias("density"), "doc_id", "chunks", "looked") for d, by in _DENSITIES.items()]
    return functools.reduce(DataFrame.unionByName, costs)


_BLANK_MARKS = f"""r AS (SELECT doc_id, unnest(x) AS lex, unnest(range(len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_0-9]+|(?s:.)') AS x FROM documents)),
s AS (SELECT doc_id, lex, sum(strlen(lex)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(lex) AS start FROM r),
d AS (SELECT doc_id, strlen(text)::BIGINT AS size, coalesce(marks, [])::BIGINT[] AS marks FROM documents LEFT JOIN (SELECT doc_id, list(start::BIGINT) FILTER (WHERE NOT regexp_full_match(lex, '[A-Za-z_0-9]+')) AS marks FROM s GROUP BY doc_id) USING (doc_id))"""


@query(f"""WITH RECURSIVE {_BLANK_MARKS}, p AS {_PLAN.split("p AS", 1)[1]}, f AS (SELECT doc_id, list_append(cuts, size) AS c FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1)
SELECT doc_id, (k - 1)::INT AS chunk, c[k] AS "begin", c[k + 1] AS "end" FROM (SELECT doc_id, c, unnest(range(1, len(c))) AS k FROM f)""")
def chunk_plan_ignoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks at blanks too, which are certified up to the ignored blanks alone."""
    own = grammars.words().set_ignored_tokens({grammars.BLANK}).compile()
    return scan.plan_chunks(table(spark, sf_dir, "documents"), own, _CHUNKS, ignoring=True)


@query(f"WITH {_WORD_TOKENS} SELECT doc_id, kind, count(*) AS serial, count(*) AS chunked, sum(length)::BIGINT AS serial_bytes, sum(length)::BIGINT AS chunked_bytes FROM t WHERE kind <> 2 GROUP BY doc_id, kind")
def ignoring_equals_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that aren't ignored, of chunks cut at blanks too and of whole texts."""
    own = grammars.words().set_ignored_tokens({grammars.BLANK}).compile()
    docs = table(spark, sf_dir, "documents")
    parts, _ = scan.tokenize_chunks(docs, own, 8, ignoring=True)
    count = lambda t, name: t.where(F.col("kind") != grammars.BLANK).groupBy("doc_id", "kind").agg(F.count("*").alias(name), F.sum("length").alias(f"{name}_bytes"))
    return count(scan.tokenize(docs, own), "serial").join(count(parts, "chunked"), ["doc_id", "kind"], "full")


@query()
def chunk_plan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks at windows, for a set that certifies no byte."""
    return scan.plan_chunks(table(spark, sf_dir, "documents"), grammars.lexer("conventional"), _CHUNKS, windows=True)


_MARK = "(start % 1009 + 1) * (length % 1013 + 1) + kind"
_LINES = r"""n AS (SELECT doc_id, unnest(x) AS lex, unnest(range(len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\n]+|\n') AS x FROM documents)),
t AS (SELECT doc_id, strlen(lex) AS length, (lex = chr(10))::INT AS kind, sum(strlen(lex)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(lex) AS start FROM n),
m AS (SELECT doc_id, count(*) AS tokens, sum(""" + _MARK + ")::BIGINT AS mark FROM t GROUP BY doc_id)"


@query(f"WITH {_LINES} SELECT doc_id, tokens AS serial, tokens AS chunked, mark AS serial_mark, mark AS chunked_mark FROM m")
def parallel_equals_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of the tokens of chunks scanned apart, and of whole texts."""
    docs = table(spark, sf_dir, "documents")
    parts, _ = scan.tokenize_chunks(docs, grammars.lexer("log lines"), 8)
    mark = lambda t, name: t.groupBy("doc_id").agg(F.count("*").alias(name), F.sum(F.expr(_MARK)).alias(f"{name}_mark"))
    return mark(scan.tokenize(docs, grammars.lexer("log lines")), "serial").join(mark(parts, "chunked"), "doc_id", "full")


#: Tokens of the scaling set as an expression, the longest alternatives first; `?` stands for a byte that it has no token for.
_SCALING = r"[A-Za-z_][A-Za-z_0-9]*|[0-9]+|[ \t\n]+|==|!=|<=|>=|[-+*/=<>(){};,]|(?s:.)"
_SCALING_TOKENS = f"""n AS (SELECT doc_id, unnest(x) AS lex, unnest(range(len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_SCALING}') AS x FROM documents)),
f AS (SELECT doc_id, min(i) AS stop FROM n WHERE NOT regexp_full_match(lex, '[A-Za-z_][A-Za-z_0-9]*|[0-9]+|[ \\t\\n]+|==|!=|<=|>=|[-+*/=<>(){{}};,]') GROUP BY doc_id),
s AS (SELECT n.doc_id, count(*) FILTER (WHERE i < coalesce(stop, i + 1)) AS serial, coalesce(sum(strlen(lex)) FILTER (WHERE i < coalesce(stop, i + 1)), 0)::BIGINT AS consumed, sum(strlen(lex))::BIGINT AS size
  FROM n LEFT JOIN f USING (doc_id) GROUP BY n.doc_id)"""


@query(f"WITH {_SCALING_TOKENS} SELECT doc_id, serial, serial AS found_in_place FROM s")
def parallel_prefix_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a text doesn't scan wholly, its serial tokens are still the first of the chunks' tokens, in the same places of the order."""
    docs = table(spark, sf_dir, "documents")
    own = grammars.scaling().compile()  # certifies bytes, and meets marks that it has no token for
    parts, _ = scan.tokenize_chunks(docs, own, 8)
    # A chunk begins after all tokens of those before it, so a token's place is its chunk's number of tokens before and its own.
    sizes = parts.groupBy("doc_id", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.join(sizes.select("doc_id", "chunk", before.alias("before")), ["doc_id", "chunk"]).select("doc_id", (F.col("before") + F.col("seq")).alias("seq"), "start", "kind", "length", F.lit(1).alias("there"))
    serial = scan.tokenize(docs, own).join(placed, ["doc_id", "seq", "start", "kind", "length"], "left")
    found = serial.groupBy("doc_id").agg(F.count("*").alias("serial"), F.count("there").alias("found_in_place"))
    return docs.where("octet_length(text) > 0").select("doc_id").join(found, "doc_id", "left").select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("serial", "found_in_place")])


@query(f"WITH RECURSIVE {_PLAN}, f AS (SELECT doc_id, size, len(cuts) AS n FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1) SELECT doc_id, n AS chunks, size AS consumed FROM f")
def chunk_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ends = scan.tokenize_chunks(table(spark, sf_dir, "documents"), grammars.lexer("log lines"), _CHUNKS)
    return ends.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("consumed").alias("consumed"))


@query()
def malformed_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of serial scans, which stop at the first unknown mark, and of chunks, which each go on to their own."""
    docs = table(spark, sf_dir, "documents")
    own = grammars.scaling().compile()
    parts, ends = scan.tokenize_chunks(docs, own, 8)
    serial = scan.scan_ends(docs, own).select("doc_id", F.col("tokens").alias("serial"), "consumed", "size")
    return serial.join(parts.groupBy("doc_id").agg(F.count("*").alias("spliced")), "doc_id", "left").join(ends.groupBy("doc_id").agg(F.count(F.when(F.col("consumed") < F.col("size"), 1)).alias("open_chunks")), "doc_id")


@query(f"WITH {_WORD_TOKENS} SELECT doc_id, kind, count(*) AS tokens, sum(length)::BIGINT AS bytes FROM t GROUP BY doc_id, kind")
def carried_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of documents cut every 4096 bytes, whatever stands there, from states carried over the cuts."""
    return carry.kind_counts(table(spark, sf_dir, "documents"), grammars.lexer("words"), piece=4096)


# Recovery.

_FIXTURES = {
    "words": [plus(any_of(Charset.range("a", "z"))), plus(text(" "))],
    "mixed": [plus(any_of(Charset.range("a", "z"))), text(";"), plus(text(" "))],
    "pair": [text("a"), text(";"), text("b")],
    "ab ba": [text("ab"), text("ba")],
    "four": [text("bb"), text("aab"), text("baa"), text("aaa")],
    "a abc": [text("a"), text("abc")],
    "a ab*c": [text("a"), concat(text("a"), kleene(text("b")), text("c")), text("b"), text("x")],
    "a abb": [text("a"), text("abb"), text("b"), text("c")],
    "a ;": [text("a"), text(";")],
}


def fixture(name: str) -> Lexer:
    out = TokenSet()
    for i, p in enumerate(_FIXTURES[name]):
        out.add_token(p, i)
    return out.compile()


@query(r"SELECT doc_id, CASE WHEN strpos(text, chr(10)) = 0 THEN -1 ELSE strlen(substr(text, 1, strpos(text, chr(10)) - 1))::BIGINT END AS start FROM documents")
def certified_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line end of each document, as the first certified start; -1 where there is none."""
    return recovery.certified_starts(table(spark, sf_dir, "documents"), grammars.lexer("log lines"), 0).select("doc_id", F.coalesce("start", F.lit(-1).cast("long")).alias("start"))


_EVIDENCE = [("words", "abc@@@def ghi", 3, 9, 6, 10, True), ("mixed", "x@ abc;", 1, 3, 2, 4, True), ("pair", "a?;b", 1, 2, 2, 3, False)]


@query(f"SELECT set_name, data, searched_from::BIGINT AS searched_from, start::BIGINT AS start, evidence_begin::BIGINT AS evidence_begin, evidence_end::BIGINT AS evidence_end, by_window FROM (VALUES {values(_EVIDENCE)}) t(set_name, data, searched_from, start, evidence_begin, evidence_end, by_window)")
def certified_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, data, at, *_ in _EVIDENCE:
        f = fixture(name).next_certified_evidence(data.encode(), at)
        rows.append((name, data, at, f.start, f.evidence_begin, f.evidence_end, f.window))
    return spark.createDataFrame(rows, "set_name string, data string, searched_from long, start long, evidence_begin long, evidence_end long, by_window boolean")


_ANCHORED = [("ab ba", "ab", 0, 0), ("ab ba", "ab", 1, -1), ("ab ba", "abab", 0, 0), ("ab ba", "abab", 1, 2), ("ab ba", "abab", 3, -1), ("ab ba", "z", 0, -1), ("four", "baaabbbb", 0, 1), ("four", "baaabbbb", 2, 4), ("four", "baaabbbb", 5, 6)]


@query(f"SELECT set_name, data, searched_from::BIGINT AS searched_from, start::BIGINT AS start FROM (VALUES {values(_ANCHORED)}) t(set_name, data, searched_from, start)")
def anchored_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(s, d, at, -1 if (x := fixture(s).next_anchored_start(d.encode(), at)) is None else x) for s, d, at, _ in _ANCHORED]
    return spark.createDataFrame(rows, "set_name string, data string, searched_from long, start long")


_REPAIRS = [("ab ba", "ab", 0), ("ab ba", "b", 1), ("ab ba", "z", -1), ("four", "b", 1), ("four", "ab", 1)]


@query(f"SELECT set_name, data, length::BIGINT AS length FROM (VALUES {values(_REPAIRS)}) t(set_name, data, length)")
def minimal_repair_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(s, d, -1 if (r := fixture(s).minimal_repair(d.encode())) is None else len(r)) for s, d, _ in _REPAIRS]
    return spark.createDataFrame(rows, "set_name string, data string, length long")


_LAGS = [("a abc", 1, True), ("a ab*c", -1, False), ("a abb", 1, False), ("a ;", 0, True)]


@query(f"SELECT set_name, lag::BIGINT AS lag, rescue_free FROM (VALUES {values(_LAGS)}) t(set_name, lag, rescue_free)")
def lag_and_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s, -1 if fixture(s).lag is None else fixture(s).lag, fixture(s).rescue_free) for s, *_ in _LAGS], "set_name string, lag long, rescue_free boolean")


@query()
def recovery_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents damaged in the middle, scanned with each way of recovering."""
    docs = table(spark, sf_dir, "documents").withColumn("data", F.col("text").cast("binary"))
    at = F.expr("cast(octet_length(data) / 2 as bigint)")
    hurt = [docs.select(F.struct("doc_id", F.lit(k).alias("damage")).alias("id"), recovery.damage(F.col("data"), k, at, F.lit(4)).alias("data")) for k in (recovery.SUBSTITUTE, recovery.DELETE, recovery.INSERT)]
    rows = recovery.landings(hurt[0].unionByName(hurt[1]).unionByName(hurt[2]), grammars.lexer("scaling"), ["certified", "skip-one", "newline", "newline token"], "id", "data")
    return rows.groupBy("id.damage", "arm").agg(F.sum("tokens").alias("tokens"), F.sum("failures").alias("failures"), F.sum("skipped").alias("skipped"), F.count(F.when(F.col("refused"), 1)).alias("refused"))


# Diagnosis.


def _diagnosed() -> dict[str, TokenSet]:
    ident = grammars.identifier()
    return {
        "shadowed": TokenSet().add_token(ident, 0, 0).add_token(text("if"), 1, 1).add_token(grammars.decimal_integer(), 2, 0),
        "tied": TokenSet().add_token(ident, 0, 1).add_token(text("if"), 1, 1).add_token(text("in"), 2, 1).add_token(text("if"), 3, 1),
        "clean": TokenSet().add_token(ident, 0, 1).add_token(text("if"), 1, 0),
    }


def _candidates(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rules = [(g, r.token, r.priority) for g, s in _diagnosed().items() for r in s.rules]
    found = [(g, i, p, t) for g, s in _diagnosed().items() for i, c in enumerate(s.candidates()) for p, t in c]
    return spark.createDataFrame(rules, "grammar string, token_id long, priority long"), spark.createDataFrame(found, "grammar string, subset int, priority long, token_id long")


@query("SELECT grammar, token_id::BIGINT AS token_id FROM (VALUES ('shadowed', 1), ('tied', 1), ('tied', 2), ('tied', 3)) t(grammar, token_id)")
def dead_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.dead_tokens(*_candidates(spark))


@query("SELECT grammar, low::BIGINT AS low, high::BIGINT AS high FROM (VALUES ('tied', 0, 1), ('tied', 0, 2), ('tied', 0, 3), ('tied', 1, 3)) t(grammar, low, high)")
def priority_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.priority_ties(_candidates(spark)[1])


# Modes.


def _strings() -> ModalTokenSet:
    """Mode 0 outside strings: quote 0, other 1; mode 1 inside: body 2, escape 3, quote 0."""
    out = ModalTokenSet().add_token(0, text('"'), 0, 1, push(1)).add_token(0, plus(any_of(Charset.all() - '"')), 1, 1)
    out.add_token(1, plus(any_of(Charset.all() - '"' - "\\")), 2, 1).add_token(1, concat(text("\\"), any_of(Charset.all())), 3, 1)
    return out.add_token(1, text('"'), 0, 1, pop())


@query(r"""WITH s AS (SELECT unnest(regexp_extract_all(props, '"[^"\\]*"|[^"]+')) AS x FROM events), q AS (SELECT x[2:-2] AS body FROM s WHERE x[1] = '"')
SELECT 0::BIGINT AS mode, 0::BIGINT AS kind, count(*) AS tokens, count(*)::BIGINT AS bytes FROM q UNION ALL SELECT 1, 0, count(*), count(*) FROM q
UNION ALL SELECT 1, 2, count(*), sum(strlen(body))::BIGINT FROM q WHERE body <> '' UNION ALL SELECT 0, 1, count(*), sum(strlen(x))::BIGINT FROM s WHERE x[1] <> '"' """)
def modal_string_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = scan.tokenize_modal(table(spark, sf_dir, "events"), _strings().compile(), "event_id", "props")
    return stats.tally(tokens, "mode", "kind")


_MODAL = [("ab \"cd\" ef", 10, 0, 0, 7), ('"a\\"b" c', 8, 0, 0, 7), ("a /* x /* y */ z */ b", 21, 0, 0, 11), ('"abc', 4, 1, 1, 2), ("/* a", 4, 2, 1, 2)]


@query(f"SELECT data, consumed::BIGINT AS consumed, mode::BIGINT AS mode, depth::BIGINT AS depth FROM (VALUES {values([m[:4] for m in _MODAL])}) t(data, consumed, mode, depth)")
def modal_stop_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, m[0]) for i, m in enumerate(_MODAL)], "case_id int, data string")
    ends = scan.modal_ends(rows, grammars.modal_code().compile(), "case_id", "data")
    return rows.join(ends, "case_id").select("data", "consumed", "mode", "depth")


@query(f"SELECT data, tokens::BIGINT AS tokens FROM (VALUES {values([(m[0], m[4]) for m in _MODAL])}) t(data, tokens)")
def modal_nested_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, m[0]) for i, m in enumerate(_MODAL)], "case_id int, data string")
    tokens = scan.tokenize_modal(rows, grammars.modal_code().compile(), "case_id", "data")
    return rows.join(tokens.groupBy("case_id").agg(F.count("*").alias("tokens")), "case_id").select("data", "tokens")


def _islands() -> ModalTokenSet:
    out = ModalTokenSet().add_token(0, text("a"), 0, 1, push(1)).add_token(1, text("b"), 1, 1, go_to(2)).add_token(2, text("c"), 2, 1, pop())
    return out.add_token(3, text("d"), 3, 1, go_to(0)).add_token(4, text("e"), 4, 1, push(4))


@query("SELECT finding, mode::BIGINT AS mode FROM (VALUES ('unreachable', 3), ('unreachable', 4), ('inescapable', 4)) t(finding, mode)")
def modal_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _islands().diagnose()
    return spark.createDataFrame([("unreachable", m) for m in d.unreachable_modes] + [("inescapable", m) for m in d.inescapable_modes], "finding string, mode long")


# Raw strings, graphs, densities.

_RAW = [
    ('R"(abc)"', 0, 8, None), ('xR"d(a)"b)d"y', 1, 11, None), ('R"( )x")"', 0, 9, None), ('"abc"', 0, None, "Not a raw string literal"), ("R", 0, None, "Not a raw string literal"),
    ('R"a b(x)a b"', 0, None, "Invalid raw string delimiter"), ('R"abcdefghijklmnopq(x)abcdefghijklmnopq"', 0, None, "Invalid raw string delimiter"), ('R"d(abc)"', 0, None, "Unterminated raw string literal"), ('R"abc', 0, None, "Unterminated raw string literal"),
]


@query(f"SELECT data, coalesce(length, -1)::BIGINT AS length, coalesce(error, '') AS error FROM (VALUES {values([(d, n, e) for d, _, n, e in _RAW])}) t(data, length, error)")
def raw_string_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(d, o) for d, o, *_ in _RAW], "data string, at int")
    return rows.select("data", scan_raw_string(F.col("data"), F.col("at")).alias("r")).select("data", F.coalesce("r.length", F.lit(-1).cast("long")).alias("length"), F.coalesce("r.error", F.lit("")).alias("error"))


@query()
def dot_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(g, line) for g in ("log lines", "JSON") for line in dot.to_dot(grammars.lexer(g).dfa).splitlines()]
    return spark.createDataFrame(rows, "grammar string, line string")


@query(r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]+|\n')) AS lex, generate_subscripts(regexp_extract_all(text, '[^\n]+|\n'), 1) AS i FROM documents),
p AS (SELECT doc_id, lex, sum(strlen(lex)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(lex) AS start FROM n),
g AS (SELECT doc_id, start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) AS gap FROM p WHERE lex = chr(10))
SELECT doc_id, count(*) AS positions, round(coalesce(avg(gap), 0), 9) AS mean_gap, coalesce(max(gap), 0)::BIGINT AS widest_gap FROM g GROUP BY doc_id""")
def split_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certified line ends of each document, and the gaps between them."""
    places = scan.tokenize(table(spark, sf_dir, "documents"), grammars.lexer("log lines")).where("kind = 1")
    return stats.gaps(places, "doc_id").withColumn("mean_gap", F.round("mean_gap", 9))


@query(f"""WITH {_WORD_TOKENS}, p AS (SELECT doc_id, kind, sum(length) OVER (PARTITION BY doc_id ORDER BY seq) - length AS start FROM t),
g AS (SELECT doc_id, start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) AS gap FROM p WHERE kind = 1)
SELECT doc_id, count(*) AS positions, round(coalesce(avg(gap), 0), 9) AS mean_gap, coalesce(max(gap), 0)::BIGINT AS widest_gap FROM g GROUP BY doc_id""")
def number_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = scan.tokenize(table(spark, sf_dir, "documents"), grammars.lexer("words")).where("kind = 1")
    return stats.gaps(places, "doc_id").withColumn("mean_gap", F.round("mean_gap", 9))


@query(f"""WITH RECURSIVE {_PLAN}, f AS (SELECT doc_id, size, list_append(cuts, size) AS c FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1),
b AS (SELECT doc_id, size, len(c) - 1 AS chunks, list_max(list_transform(range(1, len(c)), lambda k: c[k + 1] - c[k])) / (size / (len(c) - 1)) AS balance FROM f)
SELECT source, count(*) AS texts, sum(size)::BIGINT AS consumed, sum(size)::BIGINT AS size, sum(chunks)::BIGINT AS chunks, round(quantile_disc(balance, 0.5), 9) AS balance_median, round(quantile_disc(balance, 0.95), 9) AS balance_p95, round(max(balance), 9) AS balance_max
FROM b JOIN documents USING (doc_id) GROUP BY source""")
def corpus_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source: texts, bytes consumed, and how even their chunks are."""
    ends = scan.planned_ends(table(spark, sf_dir, "documents"), grammars.lexer("log lines"), _CHUNKS, "source")
    rows = ends.select("*", stats.evenness(F.col("largest"), F.col("size"), F.col("chunks")).alias("balance"), F.lit(1).cast("long").alias("text"))
    percents = {"balance_median": 50, "balance_p95": 95, "balance_max": 100}
    found = stats.quantiles(rows, "source", "balance", percents, texts="text", consumed="consumed", size="size", chunks="chunks")
    return found.withColumns({n: F.round(n, 9) for n in percents})


@query(lambda: f"WITH RECURSIVE {_delta_sql(_lexers())} SELECT DISTINCT grammar, state::INT AS state FROM (SELECT d.grammar, d.next AS state FROM delta d JOIN reached r ON r.grammar = d.grammar AND r.state = d.state WHERE d.byte = 10 UNION ALL SELECT grammar, 0 FROM reached)")
def line_start_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, _, s = _relations(spark)
    return stats.line_start_states(d, s)


@query("""SELECT (CASE WHEN regexp_full_match(lex, '[A-Za-z_][A-Za-z_0-9]*') THEN 0 WHEN regexp_full_match(lex, '[0-9]+') THEN 1 WHEN regexp_full_match(lex, '[ \\t\\n\\r]+') THEN 2 ELSE 3 END)::BIGINT AS kind, count(*) AS tokens, sum(strlen(lex))::BIGINT AS bytes
FROM (SELECT unnest(regexp_extract_all(x, '[A-Za-z_][A-Za-z_0-9]*|[0-9]+|[ \\t\\n\\r]+|(?s:.)')) AS lex FROM (SELECT string_agg(coalesce(text, ''), '' ORDER BY turn) AS x FROM conversations GROUP BY conv_id)) GROUP BY 1""")
def streaming_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as parts of one text each, scanned as a stream: tokens may begin in one turn and end in the next."""
    from ..streaming import stream_tokens
    from ..streaming.replay import replay

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("part"), F.col("text").cast("binary").alias("data"))
    last = turns.groupBy("key").agg(F.max("part").alias("end"))
    parts = turns.join(last, "key").select("key", "part", "data", (F.col("part") == F.col("end")).alias("last"))
    return stats.tally(replay(parts, lambda p: stream_tokens(p, grammars.lexer("words"))), "kind")
