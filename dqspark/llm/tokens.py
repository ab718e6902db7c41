"""Whole-text token ids of a byte-level BPE vocabulary of the tokenizers library.

The ids are those of the library. It reads about a sixth of what the rank encoder does a second,
so texts of characters whose classes all Unicode versions share, without the string of a special
token, go to the rank encoder with the same vocabulary, whose ids are equal there; all others go
to the library itself.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np
import public_tokenizers

from dqspark.llm.bpe import encoding

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as ranks.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
END = 2
#: Characters on which both regular expression engines agree: letters, digits, marks and the usual
#: white space of long-settled blocks.
_SETTLED = bytes([9, 10, 13, *range(32, 127), *range(161, 256)])
_OTHER = re.compile("[^\t\n\r -~¡-ɏΑ-ΡΣ-ωА-я–—‘’"
                    "“”…€]")


def settled(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _SETTLED)
    except UnicodeEncodeError:
        return not _OTHER.search(text)


class TextEncoder:
    def __init__(self, path: str, ranks: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.plain = ranks and encoding(ranks, public_tokenizers.PATTERN)

    def ids(self, text: str, end: int | None = END) -> np.ndarray:
        """Ids of a text (unsigned 32 bits), with ``end`` appended unless it is None."""
        if self.plain and settled(text) and not any(s in text for s in self.special):
            ids = np.array(self.plain.encode_ordinary(text), np.uint32)
        else:
            ids = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return ids if end is None else np.append(ids, np.uint32(end))


@cache
def encoder(path: str) -> TextEncoder:
    """One encoder per worker process; only the public vocabulary has ranks beside it."""
    return TextEncoder(path, RANKS if path == VOCABULARY else None)
