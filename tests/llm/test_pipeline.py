import random

import corpus_pipeline as C
from codesim.llm import decontam, packing, pii, quality, simhash

from .test_simhash import brute_components, brute_print


def test_stages_against_brute_force(spark, tmp_path, docs_of):
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n))
    leak = prose(15)
    rows = [(i, prose(rng.randint(60, 300))) for i in range(300)]
    rows += [(400 + i, rows[i][1]) for i in range(40)]
    rows += [(500 + i, prose(40) + " " + leak + " " + prose(40)) for i in range(10)]
    rows += [(600 + i, prose(80).replace(" ", "#$% ")) for i in range(10)] + [(700, None), (701, "short")]
    rows += [(800, prose(60) + " write to some.body@example.com or 4111111111111111 now " + prose(20))]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = C.run(spark, str(tmp_path)).collect()

    keep = [r for r in rows if r[0] < 600 or r[0] >= 800]  # quality
    least = brute_components({d: brute_print(t) for d, t in keep})
    keep = [r for r in keep if least[r[0]] == r[0] and not 500 <= r[0] < 510]
    assert {r.doc_id for r in got} == {d for d, _ in keep}
    texts = {r.doc_id: r.text for r in pii.pseudonymised(docs_of(keep), C.TEST_KEY).collect()}
    assert "some.body" not in texts[800] and "4111111111111111" not in texts[800] and texts[0] == rows[0][1]
    want = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packing.packed(docs_of([(d, texts[d]) for d, _ in keep])).collect())
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == want


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path, docs_of):
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of([])
    assert [n for n, _ in C.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pii_pseudonyms", "pack"]
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names and out.count() == 0
    assert C.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
