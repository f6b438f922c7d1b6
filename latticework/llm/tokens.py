"""The public vocabularies, loaded once in a Python worker."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

END = "<|endoftext|>"


@lru_cache(maxsize=4)
def byte_bpe(path: str | None = None):
    """Encoder for the ids of ``byte_bpe_50k.json``: ``path`` is its rank file; None: that of public_tokenizers."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: len(ranks)})


def multi_path() -> str:
    """Rank file of the byte-level vocabulary for many languages; ``byte_bpe`` and ``token_kinds`` take it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=1)
def piece_bpe():
    """The vocabulary with byte fallback, and which of its ids are single bytes."""
    import public_tokenizers
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return pieces, np.array([pieces.is_byte(i) for i in range(pieces.vocab_size())])


def ids_of(encoder, text) -> np.ndarray:
    """Token ids of a text (null: none); the end marker's own string is its id, as the json vocabulary reads it."""
    if not isinstance(text, str) or not text:
        return np.empty(0, np.uint32)
    special = {END} if END in text else set()
    return np.asarray(encoder.encode_to_numpy(text, allowed_special=special, disallowed_special=()), np.uint32)


@lru_cache(maxsize=4)
def token_kinds(path: str | None = None) -> np.ndarray:
    """Which ids are pieces of a character only: bytes had to be used."""
    encoder = byte_bpe(path)
    pieces = np.zeros(encoder.n_vocab, bool)
    for i in range(encoder.n_vocab - 1):
        try:
            encoder.decode_single_token_bytes(i).decode("utf-8")
        except UnicodeDecodeError:
            pieces[i] = True
    return pieces


@lru_cache(maxsize=4)
def token_lengths(path: str | None = None) -> np.ndarray:
    """Bytes of each id's token."""
    encoder = byte_bpe(path)
    return np.array([len(encoder.decode_single_token_bytes(i)) for i in range(encoder.n_vocab)], np.int64)
