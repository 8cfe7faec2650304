import pandas as pd

from palimpsest.functions import decoders, text
from palimpsest.operators import mutation, payload


def sizes(frames):
    return [len(f) for f in frames]


def test_decodings_are_given_out_before_a_batch_is_done(monkeypatch):
    monkeypatch.setattr(decoders, "AT_ONCE", 2000)
    texts = pd.Series(["bm90aGluZyB0byBzZWUgaGVyZSBhdCBhbGw=" * 4, None, ""] * 20)
    whole = pd.concat(list(decoders.hidden_texts.func(iter([texts, texts[:0]]))), ignore_index=True)
    assert [x for x in whole["decodings"]] == [decoders.decodings(t)[1] if t is not None else None for t in texts]
    assert max(sizes(decoders.hidden_texts.func(iter([texts])))) < 20


def test_trees_are_given_out_in_parts(spark):
    rows = [(pd.Series(['{"a": "b"}'] * 1000), pd.Series([None] * 1000)), (pd.Series([], dtype=object), pd.Series([], dtype=object))]
    assert sizes(x[0] for x in text.in_parts(iter(rows))) == [256, 256, 256, 232, 0]
    for walk in (mutation._mutate, mutation._restore):
        assert sizes(mutation._leaves(walk).func(r[0] for r in rows)) == [256, 256, 256, 232, 0]
        assert sizes(mutation._rebuilt(walk).func(iter(rows))) == [256, 256, 256, 232, 0]
    assert payload.T.AT_ONCE == 256
