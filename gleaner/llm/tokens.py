"""Public tokenizers over many texts, with the ids their library gives, at less cost.

Both vocabularies cut a text into words with a regular expression and encode each word by itself. Texts of
printable ASCII and Latin letters take a quicker way to the same ids; every other text, and any that may hold a
special token, goes to the library whole. Tests compare both ways.
"""

from __future__ import annotations

import hashlib
import os
import re

CACHED_WORDS = 1_000_000  # words a task remembers; the memory is emptied when it is full
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼½¾"
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ſ]*")  # without İ, whose lower case is two characters
# fixed value: the word pattern of the lower-case vocabulary, its classes listed for plain texts
LOWER_WORDS = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\t\n\r {_LETTER}{_NUMBER}]+"


def place(name: str) -> str:
    """Where the vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def version(name: str) -> str:
    """Digest of the vocabulary file: counts made with another one never match it."""
    with open(place(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def library(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
    from tokenizers import Tokenizer

    return Tokenizer.from_file(place(name))


def byte_ids(name: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken"):
    """A function from a text to its ids; plain texts use the same vocabulary in its form of ranks."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(place(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    whole = library(name)

    def ids(text: str) -> list[int]:
        if "<|" in text or not PLAIN.fullmatch(text):
            return whole.encode(text, add_special_tokens=False).ids
        return quick.encode_ordinary(text)

    return ids


def lower_counts(name: str = "word_bpe_49k.json"):
    """A function from a text to its number of tokens, for the lower-case vocabulary that marks ends of words.

    A task encodes each distinct word once: new words of letters are joined by blanks into one text, and the
    tokens that end a word tell them apart again.
    """
    import numpy as np

    whole = library(name)
    ends = np.zeros(whole.get_vocab_size(), bool)
    ends[[i for t, i in whole.get_vocab().items() if t.endswith("</w>")]] = True
    cut, letters = re.compile(LOWER_WORDS).findall, re.compile(f"[{_LETTER}]+").fullmatch
    known: dict[str, int] = {}

    def alone(text: str) -> int:
        return len(whole.encode(text, add_special_tokens=False).ids)

    def learn(words: set) -> None:
        if len(known) > CACHED_WORDS:
            known.clear()
        joined = [w for w in words if letters(w)]
        if joined:
            ids = np.array(whole.encode(" ".join(joined), add_special_tokens=False).ids)
            last = np.flatnonzero(ends[ids])
            if len(last) != len(joined):
                raise ValueError(f"{name} does not mark ends of words")
            known.update(zip(joined, np.diff(last, prepend=-1).tolist(), strict=True))
        known.update((w, alone(w)) for w in words if not letters(w))

    def count(text: str) -> int:
        if "<|" in text or not PLAIN.fullmatch(text):
            return alone(text)
        words = cut(text.lower())
        try:
            return sum([known[w] for w in words])
        except KeyError:
            learn({w for w in words if w not in known} if len(known) <= CACHED_WORDS else set(words))
            return sum([known[w] for w in words])

    return count
