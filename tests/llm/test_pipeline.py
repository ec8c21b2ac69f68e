"""The pipeline's stages on the smallest tables against what each decides."""

from conftest import SMALL

import corpus_pipeline
from tillscope.session import settle


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, SMALL))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        sizes.append(out.count())
        docs = out
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[4] == sizes[5] > 0
