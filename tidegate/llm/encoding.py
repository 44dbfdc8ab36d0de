"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

#: Runs without or of white space this long go to the library whose merge loop is not quadratic.
LONG_RUN = 1000

_LONG = re.compile(r"\S{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a text, equal to those of the tokenizer file with add_special_tokens=False.

    The file's vocabulary as ranks, which lies beside it, gives the same ids several times faster. A text that holds
    one of the file's added tokens literally gets that token's id there, so such texts go to the file's tokenizer.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.slow.get_added_tokens_decoder().values())
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str | None) -> array:
        """Ids as an array of unsigned 32-bit numbers; a null text is empty."""
        if not text:
            return array("I")
        if _LONG.search(text) or any(t in text for t in self.added):
            return array("I", self.slow.encode(text, add_special_tokens=False).ids)
        return array("I", self.fast(text))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)
