"""Readers of public tokenizer files. The driver reads a file's bytes; tasks get the bytes, not the path."""

from __future__ import annotations

import base64
import json

#: Fixed value: the pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_ranks(body: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in body.splitlines() if line)}


def json_encoder(body: bytes):
    """A function from text to ids (uint32) for a byte-level BPE vocabulary in JSON.

    Where the file lists its merges in the order of the ids, which makes the id a rank, and has no normaliser,
    the rank library gives the same ids about four times as fast; otherwise the file's own library is used.
    """
    import numpy as np

    spec = json.loads(body)
    model, symbols = spec["model"], byte_symbols()
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
    order = [model["vocab"].get(a + b, -1) for a, b in pairs]
    pre = spec.get("pre_tokenizer") or {}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    plain_special = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
    as_ranks = (
        all(a < b for a, b in zip(order, order[1:])) and plain_special and not spec.get("normalizer")
        and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex")
        and not model.get("ignore_merges") and not model.get("end_of_word_suffix")
    )
    if as_ranks:
        import tiktoken

        ranks = {bytes(symbols[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        names = set(special)

        def encode(text: str) -> np.ndarray:
            return encoding.encode_to_numpy(text, allowed_special=names, disallowed_special=())

        return encode
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(body.decode())
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
