import collections
import random

from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import mix_sources

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(21)
    syllables = ["ba", "ko", "ri", "tes", "lum", "an", "er", "st", "io", "ven"]
    text = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n)) + "."
    rows = [(i, text(rng.randrange(60, 150)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end", "en", "s0", 1) for i in range(5)] + [(200 + i, " ".join(w + "###" for w in text(80).split()), "en", "s1", 1) for i in range(12)]
    rows += [(300, text(80) + " password=b7db7aa4a5fcc78305 " + text(5), "en", "s2", 1), (None, text(90), None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        seen.append(docs)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
    good, near, secrets, mixed, packed = seen
    ids = lambda d: {r[0] for r in d.select("doc_id").collect()}
    assert ids(good) == {r[0] for r in rows if r[0] is None or not 200 <= r[0] < 300}
    assert ids(near) == {r[0] for r in rows if r[0] is None or r[0] < 100 or r[0] == 300} and near.count() == 62
    assert secrets.where("text like '%b7db7aa4%'").count() == 0 and secrets.where("text like '%[SECRET]%'").count() == 1 and secrets.count() == near.count()
    times = collections.Counter(r[0] for r in mixed.select("doc_id").collect())
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mix_sources.mix_sources(secrets, whole=True).collect() if r["size"]}
    assert times == collections.Counter({k: v for k, v in taken.items() if v})
    assert packed.where("start = 0").count() == mixed.count() and packed.agg(F.max("length")).first()[0] <= 1024
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_tokens").distinct().collect())) == sorted(map(tuple, packed.select("doc_tokens").distinct().collect()))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
