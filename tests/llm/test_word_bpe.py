"""Ids of word BPE against the library: every code point, mixed scripts, words of any length."""

import random

import tokenizers

from citeplane.llm import word_bpe
from citeplane.llm.queries import tokenizer_path


def both():
    path = tokenizer_path("word_bpe_49k.json")
    return tokenizers.Tokenizer.from_file(path), word_bpe.Tokenizer(path)


def test_every_code_point():
    library, own = both()
    every = [f"a{chr(c)}B" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(every), 20_000):
        part = every[i : i + 20_000]
        assert [e.ids for e in library.encode_batch(part, add_special_tokens=False)] == [x.tolist() for x in own.encode(part)]


def test_mixed_and_long():
    """Also words without spaces of thousands of bytes, whose parts are proposed and repaired around failing pairs."""
    library, own = both()
    rng = random.Random(5)
    pools = ["abcdefghij '-<|>", "abcABC éÉßﬀΣσςİıŁ", "日本語中文字", "0123456789٣४Ⅷ½ ", "ְ̧́̈e a", "\U0001f600\U00011380\U00011382\U000113c9\U00016d63\U00016d67՘\U000323b0 x", "<|startoftext|> <|endoftext|> 's 't 're"]
    texts = []
    for _ in range(3000):
        letters = rng.choice(pools) + rng.choice(pools)
        texts.append("".join(rng.choice(letters) if rng.random() < 0.97 else chr(rng.choice([rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.choice([5, 20, 60, 200]))))
    for n in (47, 48, 49, 97, 400, 3000):
        texts += ["".join(rng.choice(letters) for _ in range(n)) for letters in ("abcdefghilmnorstuaeio", "aeéñ", "日本語中文字的一是不了人我在有他这", "ab") for _ in range(10)]
    texts += ["ab" * 40_000, "".join(rng.choice("日本語中文字的一是不了人") for _ in range(20_000))]
    for text, got in zip(texts, own.encode(texts)):
        assert library.encode(text, add_special_tokens=False).ids == got.tolist(), ascii(text[:80])


def test_memory_of_a_worker(spark):
    """The cache forgets texts without spaces and stays bounded; the decoded text is made only where it is asked for."""
    library, own = both()
    texts = ["plain words " + "x" * 5000 + " " + "ab" * 40, "", "x" * 5000 + "\nplain"]
    for _ in range(2):
        for text, got in zip(texts, own.encode(texts)):
            assert library.encode(text, add_special_tokens=False).ids == got.tolist()
        assert set(own.cache) == {"plain", "words", ""}
    for i in range(12):
        own.encode([" ".join(f"w{i * 20_000 + j}" for j in range(20_000))])
        assert len(own.cache) <= 100_000
    docs = spark.createDataFrame([(1, texts[0]), (2, None)], "doc_id long, text string")
    path = tokenizer_path("word_bpe_49k.json")
    short, whole = word_bpe.encode(docs, path, decoded=False), word_bpe.encode(docs, path)
    assert short.columns == ["doc_id", "ids"] and sorted(short.collect()) == sorted(whole.select("doc_id", "ids").collect())
