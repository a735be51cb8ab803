"""The pipeline's stages on a small table: each one's decisions take effect, and nulls and strange rows pass through."""

import hashlib
import random

import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["calm", "river", "stone", "walks", "under", "light", "green", "over", "small", "birds"]
    good = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(n))
    passage, leak = good(60), good(30)
    docs = [(i, good(200)) for i in range(120)]
    docs += [(200, docs[0][1]), (201, docs[1][1] + " tail"), (202, good(100) + " " + passage + " " + good(100)), (203, good(100) + " " + passage + " " + good(100)), (204, good(40) + " " + leak + " " + good(40))]
    short = " ".join(leak.split()[3:16])
    docs += [(205, good(1000) + " " + short + " " + good(1000)), (206, good(1000) + " " + " ".join(short.split()[:12]) + " " + good(1000))]
    docs += [(300 + i, " ".join(["BUY NOW!! $$$"] * 40)) for i in range(60)]
    docs += [(None, good(50)), (400, None), (401, ""), (402, "短い text"), (200, docs[0][1])]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, hash int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(300 + i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(docs), passage


def test_stages(spark, sf, tmp_path):
    folder, texts, passage = sf
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns, name
        kept.append({r["doc_id"]: r for r in docs.collect()})
    quality, near, passages, clean, encoded = kept
    assert not any(300 <= (i or 0) < 400 for i in quality) and all(i in quality for i in range(120)) and None in quality
    assert 200 not in near and 201 not in near and all(i in near for i in range(120))
    assert passage in passages[202]["text"] and passage not in passages[203]["text"] and passages[203]["n_chars"] == len(passages[203]["text"])
    assert all(passages[i]["text"] == texts[i] for i in range(120))
    # A window of 13 words goes with its document even where it is no 20th of it; 12 words of it are no window.
    assert {204, 205, 206} <= set(passages) and not {204, 205} & set(clean) and {202, 206} <= set(clean)
    for i, r in encoded.items():
        assert r["decoded_sha256"] == hashlib.sha256((clean[i]["text"] or "").encode()).hexdigest() and r["n_tokens"] == len(r["ids"])


def test_repeated_passages_in_more_shards_than_files_may_be_open(spark, sf, monkeypatch):
    from tokenlake.llm import shared, superkmer

    from .test_operators import few_files, small_shards

    tasks = []
    small_shards(monkeypatch, superkmer)
    monkeypatch.setattr(superkmer, "tidy", lambda run: tasks.append(run) or shared.tidy(run))
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet")
    corpus_pipeline.repeated_passages(spark, docs, sf[0])
    rows = [r.asDict() for r in docs.collect()]
    batch = pa.record_batch([pa.array(rows), pa.array([r["doc_id"] for r in rows]), pa.array([r["text"] for r in rows])], names=["row", "id", "t"])
    with few_files():
        kept = {r["row"]["doc_id"]: r["kept"] for b in tasks[-1]([batch]) for r in b.to_pylist()}
    assert len(kept) == len(sf[1]) and sf[2] in kept[202] and sf[2] not in kept[203]


def test_encoding_takes_one_worker_a_task(spark, sf):
    from tokenlake.llm import bpe

    docs = spark.read.parquet(f"{sf[0]}/documents.parquet")
    files = corpus_pipeline.bpe_files()
    out = corpus_pipeline.encoding(spark, docs, sf[0])
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    plain = bpe.decode(bpe.encode(docs, *files, columns=["doc_id"]), *files).collect()
    rows = lambda found: sorted(found, key=repr)
    assert rows((r["doc_id"], r["ids"], r["decoded_sha256"]) for r in out.collect()) == rows((r["row"]["doc_id"], r["ids"], hashlib.sha256(r["decoded"]).hexdigest()) for r in plain)


def test_empty_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf[0]).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.count() == 0
