"""Token ids of whole texts as packed little-endian 32-bit integers.

Ids are those of the tokenizer file. Texts of plain Latin, where every Unicode version agrees on the
character classes, are encoded from the same vocabulary's rank file, which is four times as fast.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Anything but printable ASCII, tab, line ends and the Latin letters of Latin-1 and Latin Extended-A and -B; and white
#: space in a row that the rank file's pattern gives up on (somewhere beyond 300,000 characters).
_ODD = re.compile("[^\t\n\r -~À-ÖØ-öø-ɏ]|[\t\n\r ]{65536}")


class Encoder:
    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> bytes:
        if self.fast and not _ODD.search(text) and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@lru_cache(maxsize=1)
def encoder(path: str, ranks: str | None = None) -> Encoder:
    """The encoder of these files; a worker that runs several tasks loads it once."""
    return Encoder(path, ranks)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
