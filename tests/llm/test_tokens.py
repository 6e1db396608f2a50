import random

from gleaner.llm import token_counts, tokens


def test_quick_ways_equal_the_library():
    ids, count = tokens.byte_ids(), tokens.lower_counts()
    a, b = tokens.library("byte_bpe_50k.json"), tokens.library("word_bpe_49k.json")
    rng = random.Random(1)
    usual, odd = "aAzZ éÉß'sdtrevlm  \n\t\r09²½ªµ!?.-_<|>~§«ſŁ", "İ\x1c\xa0́漢😀 Σς"
    for i in range(4000):
        text = "".join(rng.choice(usual + odd * (i % 4 == 0)) for _ in range(rng.randint(0, 40)))
        if i % 3 == 0:
            text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(1, 60)))
        assert ids(text) == a.encode(text, add_special_tokens=False).ids
        assert count(text) == len(b.encode(text, add_special_tokens=False).ids)


def test_memory_that_is_emptied(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 5)
    count, b = tokens.lower_counts(), tokens.library("word_bpe_49k.json")
    for text in ("one two three four five six", "seven one two 8 !!", "one nine ten"):
        assert count(text) == len(b.encode(text, add_special_tokens=False).ids)


def test_counts_and_cache(spark, docs, tmp_path):
    path = str(tmp_path / "cache")
    b = tokens.library("word_bpe_49k.json")
    pairs = [(1, None), (2, ""), (3, "The  cat\n\nsat"), (3, "The cat sat"), (None, "É <|endoftext|> x"), (4, "ab " * 30000)]
    rows = token_counts.token_counts(docs(pairs), path).collect()
    want = [
        (str(i), len((t or "").encode()), len(b.encode(t or "", add_special_tokens=False).ids)) for i, t in pairs
    ]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == sorted(want)
    assert {str(r.doc_id): r.over_limit for r in rows}["4"] is True
    assert spark.read.parquet(path).count() == 4  # null and empty text, and both spellings of 3, share a row each
    token_counts.token_counts(docs([(9, "The cat\tsat"), (8, "new")]), path).collect()
    assert spark.read.parquet(path).count() == 5


def test_stored_counts_are_used(spark, docs, tmp_path):
    path, version = str(tmp_path / "cache"), tokens.version("word_bpe_49k.json")
    key = docs([(1, "hello")]).select(token_counts.digest("text")).first()[0]
    spark.createDataFrame([(key, version, 77), (key, "other", 5)], token_counts.CACHE_SCHEMA).write.parquet(path)
    assert token_counts.token_counts(docs([(1, "hello")]), path).first().n_tokens == 77


def test_empty_table(docs, tmp_path):
    assert token_counts.token_counts(docs([(1, "a")]).limit(0), str(tmp_path / "c")).collect() == []
