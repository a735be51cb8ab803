"""Scans of DataFrames, sources, streams."""

import pytest
from pyspark.sql import functions as F

from tokenlake import sources
from tokenlake.functions.rawstring import BAD_DELIMITER, NOT_RAW, UNTERMINATED, scan_raw_string
from tokenlake.operators import dot, recovery, relations, scan
from tokenlake.operators.tokenset import TokenSet
from tokenlake.plans import grammars, stats
from tokenlake.streaming import settled, stream_tokens
from tokenlake.streaming.replay import replay


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "abc 12"), (2, ""), (3, None), (4, "é x"), (None, "q"), (5, "  " * 400 + "end"), (6, "L" * 200_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_tokens_cover_texts(docs):
    lexer = grammars.lexer("words")
    rows = scan.tokenize(docs, lexer, lexemes=True, payload=True).orderBy("doc_id", "seq").collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        assert len(r["lexeme"]) == r["length"]
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all(b"".join(bytes(r["lexeme"]) for r in by.get(i, [])) == t for i, t in texts.items())
    assert [(r["kind"], r["start"], r["length"]) for r in by[1]] == [(0, 0, 3), (2, 3, 1), (1, 4, 2)]
    ends = {r["doc_id"]: r for r in scan.scan_ends(docs, lexer).collect()}
    assert all(ends[i]["consumed"] == ends[i]["size"] == len(t) and ends[i]["tokens"] == len(by.get(i, [])) for i, t in texts.items())
    counts = {(r["doc_id"], r["kind"]): (r["tokens"], r["bytes"]) for r in scan.kind_counts(docs, lexer).collect()}
    assert counts[5, 2] == (1, 800) and counts[6, 0] == (1, 200_000) and sum(n for n, _ in counts.values()) == len(rows)
    assert scan.tokenize(docs.limit(0), lexer).count() == 0 and scan.kind_counts(docs.limit(0), lexer).count() == 0


def test_stop_conditions_and_checksum(docs):
    tokens = scan.tokenize(docs, grammars.lexer("words"))
    assert scan.until(tokens, F.col("kind") == 2).where("doc_id = 1").count() == 2
    sums = {r["doc_id"]: r["checksum"] for r in stats.order_checksum(tokens, "doc_id").collect()}
    assert sums[1] == ((1 * 31 + 3) * 31 + 2) % stats.MODULUS


def test_chunks_of_malformed_texts_keep_the_serial_prefix(spark):
    rows = spark.createDataFrame([(1, "a+b(c)?d;e" * 30), (2, "a;?;a"), (3, "")], "doc_id long, text string")
    lexer = grammars.lexer("scaling")
    parts, ends = scan.tokenize_chunks(rows, lexer, 4)
    serial = scan.tokenize(rows, lexer)
    for i in (1, 2):
        a = [(r["kind"], r["start"], r["length"]) for r in serial.where(f"doc_id = {i}").orderBy("seq").collect()]
        b = [(r["kind"], r["start"], r["length"]) for r in parts.where(f"doc_id = {i}").orderBy("chunk", "seq").collect()]
        assert b[: len(a)] == a
    assert ends.where("doc_id = 1 AND consumed < size").count() > 0


def test_stream_settles_what_cannot_change():
    lexer = TokenSet().add_token(grammars.text("a"), 0).add_token(grammars.text("abc"), 1).add_token(grammars.text("b"), 2).compile()
    assert settled(lexer, b"ab") == ([], 0, False) and settled(lexer, b"abc") == ([(1, 3)], 3, False) and settled(lexer, b"abb") == ([(0, 1), (2, 1), (2, 1)], 3, False)
    assert settled(lexer, b"bx")[2] is True


def test_streamed_parts_equal_the_whole(spark):
    text = "alpha 12 beta_3 \n gamma 45 6"
    for cut in (1, 3, 7):
        parts = [("k", i, text[i * cut : (i + 1) * cut].encode(), (i + 1) * cut >= len(text)) for i in range(-(-len(text) // cut))]
        rows = spark.createDataFrame([*parts, ("other", 0, b"x", True)], "key string, part long, data binary, last boolean").coalesce(1)
        got = replay(rows, lambda p: stream_tokens(p, grammars.lexer("words"))).where("key = 'k'").orderBy("start").collect()
        assert [(r["kind"], r["length"]) for r in got] == grammars.lexer("words").scan(text.encode())[0]


def test_files_split_at_certified_bytes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.log").write_bytes(b"one\ntwo\n\nthree")
    rows = sources.read_split(spark, str(tmp_path / "sub"), grammars.lexer("log lines"), 10)
    assert sorted(bytes(r["data"]) for r in rows.collect()) == [b"", b"one", b"three", b"two"]
    with pytest.raises(ValueError):
        sources.read_split(spark, str(tmp_path), grammars.lexer("JSON"), 10)
    files = sources.read_files(spark, str(tmp_path), "*.log")
    assert files.first()["size"] == 14
    tokens = scan.tokenize(files, grammars.lexer("log lines"), "path", "data", lexemes=True)
    sources.write_tokens(tokens, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 6


def test_relations_agree_with_the_lexer(spark):
    own = {g: grammars.lexer(g) for g in ("base + strings", "log lines", "scaling")}
    d, a, s = relations.delta(spark, own), relations.accept(spark, own), relations.starts(spark, own)
    for relaxed in (False, True):
        got = {(r["grammar"], r["byte"]) for r in relations.split_points(d, a, s, relaxed).collect()}
        assert got == {(g, b) for g, x in own.items() for b in range(256) if (x.split_points_ignoring if relaxed else x.split_points)[b]}


def test_raw_strings(spark):
    rows = spark.createDataFrame([('R"(x)"', 6, None), ('R"--(a)")--"', 12, None), ('R"a\\(x)a\\"', None, BAD_DELIMITER), ("x", None, NOT_RAW), ('R"abc', None, UNTERMINATED), ('R"ab(', None, UNTERMINATED), (None, None, NOT_RAW)], "s string, n long, e string")
    for r in rows.select("n", "e", scan_raw_string(F.col("s")).alias("r")).collect():
        assert (r["r"]["length"], r["r"]["error"]) == (r["n"], r["e"])


def test_recovery_and_damage(spark):
    lexer = grammars.lexer("log lines")
    rows = spark.createDataFrame([(1, b"ab\ncd\nef")], "doc_id long, data binary")
    for kind, want in ((recovery.SUBSTITUTE, b"ab\n\x01\x01\nef"), (recovery.DELETE, b"ab\n\nef"), (recovery.INSERT, b"ab\n\x01\x01cd\nef")):
        assert bytes(rows.select(recovery.damage(F.col("data"), kind, F.lit(3), F.lit(2)).alias("x")).first()["x"]) == want
    assert recovery.pristine_offset(recovery.DELETE, 3, 3, 2) == 5 and recovery.pristine_offset(recovery.INSERT, 4, 3, 2) is None
    words = TokenSet().add_token(grammars.plus(grammars.any_of("ab")), 0).add_token(grammars.text(";"), 1).compile()
    landed = recovery.run_arm(words, b"ab;??;ab", recovery.certified)
    assert (landed.failures, landed.refused) == (1, False) and recovery.run_arm(words, b"a?", recovery.certified).refused
    assert lexer.next_certified_start(b"ab\n", 0) == 2


def test_carried_states_equal_the_serial_scan(spark, docs):
    import random

    from tests.test_lexer import random_set
    from tokenlake.operators import carry

    rng, tried = random.Random(31), 0
    for _ in range(120):
        lexer = random_set(rng)[0].compile()
        if lexer.nullable or lexer.lag != 0:
            continue
        c, tried = carry.Carry(lexer), tried + 1
        for _ in range(10):
            data = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30))).encode()
            n, state, ends = rng.randint(1, 6), 0, []
            for at in range(0, len(data), n):
                part = data[at : at + n]
                ends += [(at + e, k) for e, k in c.ends(part, state, at + n >= len(data))]
                assert c.effect(part)[state] == c.run(part, state)
                state = c.effect(part)[state]
            serial, at = [], 0
            for k, size in lexer.scan(data)[0]:
                at += size
                serial.append((at, k))
            assert ends == serial
    assert tried > 20
    known = docs.where("doc_id IS NOT NULL")
    got = carry.tokenize(known, grammars.lexer("words"), piece=7).select("doc_id", "kind", "start", "length")
    whole = scan.tokenize(known, grammars.lexer("words")).select("doc_id", "kind", "start", "length")
    assert got.exceptAll(whole).count() == 0 and whole.exceptAll(got).count() == 0
    with pytest.raises(ValueError):
        carry.Carry(grammars.lexer("JSON"))


def test_carried_tallies_are_made_in_the_pieces(spark):
    from tokenlake.operators import carry

    lexer = grammars.lexer("words")
    c, data = carry.Carry(lexer), "ab  12é".encode() * 9
    for lo in range(5):
        effect, last = c.passage(data[lo:])
        assert effect == c.effect(data[lo:])
        for state in range(len(effect)):
            ends = [e for e, _ in c.ends(data[lo:], state, False)]
            assert last[state] == (ends[-1] if ends else -1)
    docs = spark.createDataFrame([(1, "x" * 50 + " 12 y"), (2, ""), (3, None), (4, "é" * 9), (5, "q"), (6, "ab 12\n" * 3000)], "doc_id long, text string")
    for piece in (7, 4096):
        got = {tuple(r) for r in carry.kind_counts(docs, lexer, piece).collect()}
        assert got == {tuple(r) for r in stats.tally(scan.tokenize(docs, lexer), "doc_id", "kind").collect()}
    plan = carry.kind_counts(docs, lexer, 7)._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_campaign_of_empty_and_null_texts(spark, tmp_path):
    import math

    from tokenlake.plans import catalog

    rows = [(1, "a b\nc 12 dé\n", "s"), (2, "", "s"), (3, None, "s"), (4, "x", "t"), (5, "", "u"), (6, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["source"]: r.asDict() for r in catalog.corpus_campaign(spark, str(tmp_path)).collect()}
    assert (got["s"]["texts"], got["s"]["consumed"], got["s"]["size"], got["s"]["chunks"]) == (3, 13, 13, 5)
    assert got["s"]["balance_median"] == 2.076923077 and math.isnan(got["s"]["balance_p95"]) and math.isnan(got["u"]["balance_max"])
    assert got["t"]["balance_median"] == 1.0 and got[None]["chunks"] == 1 and got[None]["size"] is None and got[None]["balance_max"] is None


def test_checksum_joins_and_gathers_no_tokens(spark):
    tokens = spark.createDataFrame([(1, i, i % 4) for i in range(3000)] + [(None, 0, 2)], "doc_id long, seq long, kind long")
    found, h = stats.order_checksum(tokens, "doc_id"), 0
    for i in range(3000):
        h = (31 * h + i % 4 + 1) % stats.MODULUS
    assert {tuple(r) for r in found.collect()} == {(1, h), (None, 3)}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_ways_of_recovering_together_equal_each_by_itself():
    import random

    import numpy as np

    from .test_lexer import random_set

    rng, arms, moved = random.Random(7), list(recovery.ARMS), 0
    sets = [(grammars.lexer("scaling"), "ab1 \n;=!.é"), (grammars.lexer("conventional"), 'a1 \n"/=!;\x01'), (grammars.lexer("JSON"), 'tru0e" \n{:\x01\\')]
    sets += [(random_set(rng)[0].compile(), "abc; \n") for _ in range(40)]
    for lexer, letters in sets:
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))).encode() for _ in range(25)] + ["".join(rng.choice(letters) for _ in range(700)).encode()]
        raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        found = recovery.Landings(lexer).run(raw, offsets, arms)
        for a in arms:
            want = [recovery.run_arm(lexer, t, recovery.ARMS[a]) for t in texts[:-1] if a != "exact"] + ([recovery.run_arm(lexer, texts[-1], recovery.ARMS[a])] if a != "exact" else [])
            assert a == "exact" or found[a].tolist() == [[w.tokens, w.failures, w.skipped, w.refused] for w in want], (a, letters)
            moved += sum(w.failures for w in want)
    assert moved > 10_000


def test_ways_of_recovering_are_not_walked_text_by_text(spark, monkeypatch):
    import numpy as np

    docs = spark.createDataFrame([(1, "ab? cd.\nint x;"), (2, ""), (3, None), (4, "é")], "doc_id long, text string")
    rows = recovery.landings(docs, grammars.lexer("scaling"), ["certified", "skip-one", "newline", "newline token"]).collect()
    assert {tuple(r) for r in rows if r["doc_id"] == 4} == {(4, a, 0, n, s, True) for a, n, s in (("certified", 1, 0), ("skip-one", 2, 1), ("newline", 1, 0), ("newline token", 1, 0))}
    assert (1, "newline", 5, 1, 6, False) in {tuple(r) for r in rows} and len(rows) == 16
    monkeypatch.setattr(recovery, "run_arm", None)
    text = "int a; é? b.\n".encode() * 500
    found = recovery.Landings(grammars.lexer("scaling")).run(np.frombuffer(text, np.uint8), np.array([0, len(text)]), ["certified", "skip-one", "newline", "newline token"])
    assert [c[0, 1] for c in found.values()] == [recovery.MOVES] * 4


def test_dot(tmp_path):
    graph = dot.to_dot(grammars.lexer("log lines").dfa, {0: "line"})
    assert graph.startswith("digraph {") and "line" in graph and dot.label([34, 92, None, 1, 97]) == '\\" \\\\ ε \\\\x01 a'
    dot.to_file(grammars.lexer("log lines").dfa, str(tmp_path / "a" / "b.dot"))
    assert (tmp_path / "a" / "b.dot").read_text().endswith("}\n")
