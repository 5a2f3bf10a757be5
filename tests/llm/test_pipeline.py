import hashlib
import random

import pytest
import sentencepiece

from .conftest import DOC, sentence


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    folder = str(tmp_path_factory.mktemp("corpus"))
    clean = [sentence(rng, rng.randint(60, 150)).capitalize() + "." for _ in range(120)]
    item = sentence(rng, 40)
    shared = sentence(rng, 70)
    rows = list(enumerate(clean))
    bad = [(1000 + i, " | ".join(w + "%%%" for w in sentence(rng, 60).split())) for i in range(60)]
    copies = [(2000 + i, clean[i] if i % 2 else clean[i].replace(clean[i].split()[7], "other", 1)) for i in range(20)]
    passages = [(3000 + i, f"{sentence(rng, 40)} {shared} {sentence(rng, 40)}") for i in range(4)]
    leaks = [(4000 + i, f"{sentence(rng, 40)} {' '.join(item.split()[i : i + 12])} {sentence(rng, 40)}") for i in range(5)]
    full = [*rows, *bad, *copies, *passages, *leaks]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in full], DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in [*rows, *bad]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(full), shared


def test_stages_and_run(spark, corpus):
    import public_tokenizers

    import corpus_pipeline

    folder, texts, shared = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "passages", "leaks", "pieces"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.settle(stage(spark, docs, folder), f"test-{name}")
        assert out.columns == docs.columns
        docs, kept[name] = out, {r.doc_id: r.text for r in out.collect()}
    assert not [i for i in kept["quality"] if 1000 <= i < 2000] and all(i in kept["quality"] for i in texts if not 1000 <= i < 2000)
    assert set(kept["quality"]) - set(kept["near_copies"]) == {i for i in texts if 2000 <= i < 3000}
    assert sum(shared in t for t in kept["passages"].values()) == 1 and shared in kept["passages"][3000]
    assert all(t == texts[i] for i, t in kept["passages"].items() if i < 3000)
    assert set(kept["passages"]) - set(kept["leaks"]) == {i for i in texts if i >= 4000}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    spark.conf.set(corpus_pipeline.BATCH, "777")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert spark.conf.get(corpus_pipeline.BATCH) == "777"
    spark.conf.unset(corpus_pipeline.BATCH)
    assert set(got) == set(kept["leaks"])
    for i, r in got.items():
        ids = library.encode(kept["leaks"][i])
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_stages_with_odd_rows(spark, frame, odd_rows, tmp_path):
    """Nulls, empty texts, repeated rows and ids, clashing names; and empty tables."""
    import corpus_pipeline

    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, "w " * 12), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (odd_rows, []):
        docs = frame(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.settle(stage(spark, docs, str(tmp_path)), f"odd-{name}")
            assert out.columns == frame(rows).columns and all(r["_doc"] == r["a.b"] == "clash" for r in out.collect())
            docs = out
        kept = sorted(map(str, (r.text for r in docs.collect())))
        assert len(kept) == (9 if rows else 0)  # two more rows of one text go
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(kept)
