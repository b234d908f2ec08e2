"""Ids of a byte-level BPE vocabulary as the tokenizers library gives them."""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa

from pulsegrid.llm import words as W
from pulsegrid.llm.chunks import Chunks, Memo


def _plain() -> np.ndarray:
    """Bytes that are no part of a white-space character: graphic ASCII, and the lead bytes C3 to DF."""
    out = np.zeros(256, dtype=bool)
    out[0x21:0x7F] = True
    out[0xC3:0xE0] = True
    return out


_PLAIN = _plain()


def chunks_of(column: pa.Array) -> Chunks:
    """Chunks that begin at a single space between two characters that are no white space.

    The splitting rule before the merges takes such a space together with what follows and nothing before it,
    whatever stands around. Only neighbours that are told apart from white space by one or two bytes count.
    """
    texts = W.Texts(column)
    data = texts.data
    before = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        graphic = (data >= 0x21) & (data < 0x7F)
        ends = graphic.copy()
        ends[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        before[1:-1] = (data[1:-1] == 0x20) & ends[:-2] & _PLAIN[data[2:]]
    return Chunks(texts, before)


@functools.lru_cache(maxsize=1)
def memo(path: str) -> Memo:
    """This worker's table of chunks for the vocabulary at ``path``."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        count = np.empty(len(chunks), dtype=np.int32)
        for a in range(0, len(chunks), 4096):
            for i, found in enumerate(library.encode_batch_fast([c.decode() for c in chunks[a : a + 4096]], add_special_tokens=False), a):
                own = found.ids
                ids += own
                count[i] = len(own)
        return np.array(ids, dtype=np.int32), count

    return Memo(encode)
