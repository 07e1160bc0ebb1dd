import random

import corpus_pipeline as pipeline
from hushframe.llm import packing, quality
from tests.llm import test_linededup, test_minhash, test_mixing, test_packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    dice = random.Random(8)
    vocabulary = [f"word{i}" for i in range(400)] + ["the", "of", "and", "to"] * 40

    def prose(n):
        return " ".join(dice.choices(vocabulary, k=n))

    shared = prose(70)
    texts = [prose(dice.randint(60, 300)) for _ in range(60)]
    texts += [f"{prose(80)}\n{shared}\n{prose(90)}" for _ in range(5)]
    base = prose(250).split()
    for _ in range(6):
        w = list(base)
        w[dice.randrange(250)] = "changed"
        texts.append(" ".join(w))
    texts += [texts[3], "too short", None, "", "$$$ %%% ### " * 80, "same same same " * 60]
    return [(i, t, "en", dice.choice(["a", "a", "a", "b", "c", None]), len(t) if t is not None else None) for i, t in enumerate(texts)]


def test_stages_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    # quality: the verdict of the measured rules, clean prose stays
    kept = pipeline.quality_rules(spark, docs, "").collect()
    ids = {r.doc_id for r in kept}
    assert set(range(72)) - {71} <= ids | {71} and not ids & set(range(len(rows) - 5, len(rows)))
    assert docs.columns == list(kept[0].asDict())
    # line dedup: lines of brute force go
    docs = spark.createDataFrame(kept, SCHEMA)
    gone = test_linededup.brute([(r.doc_id, r.text) for r in kept], 50)
    cleaned = pipeline.line_dedup(spark, docs, "").collect()
    want = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[r.doc_id]) for r in kept}
    assert {r.doc_id: r.text for r in cleaned} == {d: t for d, t in want.items() if t.strip()}
    assert sum(bool(v) for v in gone.values()) >= 5
    # near-dedup: the smallest id of each component of brute force
    docs = spark.createDataFrame(cleaned, SCHEMA)
    heads = {c for _, _, c in test_minhash.brute([(r.doc_id, r.text) for r in cleaned], 5, 80)}
    single = pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in single) == sorted(heads) and len(heads) < len(cleaned)
    # mixing: each source near its target
    docs = spark.createDataFrame(single, SCHEMA)
    mixed = pipeline.mix_sources(spark, docs, "").collect()
    size = lambda t: len(t.split())
    sizes, taken = {}, {}
    for r in single:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    for s, target in test_mixing.brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= 300
    # packing: every copy is packed whole
    packed = pipeline.pack(spark, spark.createDataFrame(mixed, SCHEMA).coalesce(1), "").collect()
    assert sum(r.length for r in packed) == sum(len(test_packing.ids_of(r.text)) for r in mixed)
    assert packing.default_tokenizer() and quality.RULES


def test_run_on_the_small_tables(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and [n for n, _ in pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "packing"]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
