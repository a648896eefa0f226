"""Token ids of a byte-level BPE vocabulary file.

The ids are those of the ``tokenizers`` library for the same file.  Where the file allows it (merge
ranks in id order and the usual split pattern, as in the public 50k vocabulary) they are computed
by ``tiktoken`` from the same vocabulary, which is about four times as fast; tests/llm compare the
two over every code point and over the test documents.  Any other file goes through ``tokenizers``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Merge ranks by token, if ids follow the order of the merges."""
    byte_of, model = _byte_of(), spec["model"]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    vocab = model["vocab"]
    made = [vocab.get("".join(m)) for m in merges]
    if None in made or made != sorted(made) or model.get("ignore_merges") or spec.get("normalizer"):
        return None
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids as unsigned 32-bit integers, without added special tokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    step = spec.get("pre_tokenizer") or {}
    plain = step.get("type") == "ByteLevel" and not step.get("add_prefix_space") and step.get("use_regex", True)
    if plain and spec["model"].get("type", "BPE") == "BPE" and (ranks := _ranks(spec)):
        import public_tokenizers
        import tiktoken

        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: np.asarray(fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
