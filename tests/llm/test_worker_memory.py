"""A Python worker gives freed memory back when its task ends."""

import pandas as pd

from bytecairn.llm import packing


def test_packing_gives_memory_back(spark, monkeypatch):
    docs, taken, calls = spark.createDataFrame([(1, "a word")], "doc_id long, text string"), [], []
    real = type(docs).mapInPandas
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, f, schema, *a, **k: taken.append(f) or real(self, f, schema, *a, **k))
    monkeypatch.setattr(packing, "give_back", lambda: calls.append(1))
    packing.pieces(docs)
    out = list(taken[0](iter([pd.DataFrame({"doc_id": [1], "text": ["a word"]})])))
    assert len(out) == 1 and out[0]["length"].tolist()[0] > 1 and calls == [1]
