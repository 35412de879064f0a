"""Token ids of whole texts, a batch at a time: each distinct blank-separated chunk of a batch is encoded once.

The ids are those of the byte-level vocabulary in byte_bpe_50k.json. They are computed from the same vocabulary's rank
file, chunk by chunk; a text in which white space meets a blank is encoded whole, so that ids never differ. That file's
added tokens (<|endoftext|>) are found in plain text too; a text that holds one is encoded whole.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Between documents.
END = 0
#: A blank at either end, or one that follows or precedes white space: chunks would not be encoded alone there.
_TANGLED = r"^ | $| [ \t\n\x0b\f\r\x1c-\x1f\x{85}\p{Z}]|[ \t\n\x0b\f\r\x1c-\x1f\x{85}\p{Z}] "


@functools.lru_cache(1)
def added_tokens() -> dict[str, int]:
    """The tokenizer file's added tokens, none of which strips or needs what surrounds it."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


@functools.lru_cache(1)
def encoder(path: str | None = None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={} if path else added_tokens())


def encode(texts: pa.Array, path: str | None = None, added: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by END, and each text's offsets into them. A null text is empty.

    With `added`, the tokenizer file's added tokens get their own id, as its tokenizer gives them; without, they are
    plain text. Another rank file (`path`) has none.
    """
    coder = encoder(path)
    run = coder.encode_ordinary
    whole_run = functools.partial(coder.encode, allowed_special="all") if added else run
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    tangled = pc.match_substring_regex(texts, _TANGLED).to_numpy(zero_copy_only=False)
    for token in coder.special_tokens_set if added else ():
        tangled = tangled | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
    plain = texts.filter(pa.array(~tangled))
    parts = pc.split_pattern(plain, " ")
    coded = parts.flatten().dictionary_encode()
    heads = parts.offsets.to_numpy()[:-1] - parts.offsets.to_numpy()[0]
    index = coded.indices.to_numpy().copy()
    ids = [run(" " + x) for x in coded.dictionary.to_pylist()]
    base = len(ids)
    # first chunks have no blank before them; each tangled text is a chunk; the last entry is END
    first = coded.dictionary.take(pa.array(index[heads])).to_pylist() if len(heads) else []
    ids += [run(x) for x in first]
    ids += [whole_run(x) for x in texts.filter(pa.array(tangled)).to_pylist()]
    ids.append([END])
    index[heads] = base + np.arange(len(heads))
    many = np.ones(n, np.int64)
    many[~tangled] = np.diff(parts.offsets.to_numpy())
    many += 1
    begin = np.cumsum(many) - many
    chunk = np.full(many.sum(), len(ids) - 1, np.int32)
    body = np.ones(len(chunk), bool)
    body[begin + many - 1] = False
    whole = np.repeat(tangled, many)
    chunk[body & ~whole] = index
    chunk[body & whole] = base + len(heads) + np.arange(tangled.sum())
    size = np.fromiter(map(len, ids), np.int32, len(ids))
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, size.sum())
    start = np.cumsum(size, dtype=np.int64) - size
    long = size[chunk]
    ends = np.cumsum(long, dtype=np.int64)
    offsets = np.concatenate([[0], ends[begin + many - 1]])
    # places below 2^31 (a slice of texts has fewer ids than bytes) as 32-bit numbers
    small = np.int32 if max(len(flat), len(chunk), offsets[-1]) < 2**31 else np.int64
    at = np.repeat((start[chunk] - (ends - long)).astype(small), long)
    del chunk, long, ends
    at += np.arange(len(at), dtype=small)
    return flat[at], offsets


def slices(texts: pa.Array, most: int = 1 << 21):
    """Index ranges of texts of about `most` bytes (one text at least)."""
    held = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(held, (held[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j


def cuts(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole up to `most`, else pieces of `most` of which the first may be shorter."""
    head = n % most or min(n, most)
    return [(0, head), *((s, most) for s in range(head, n, most))]
