"""Token ids of the public byte-level BPE vocabulary.

The vocabulary is given as a file of ranks; ids equal those of ``tokenizers``
on the JSON form of the same vocabulary (checked in tests), which takes several
times as long.
"""

from __future__ import annotations

import base64

END_OF_TEXT = "<|endoftext|>"
END_OF_TEXT_ID = 50256


def default_vocabulary() -> str:
    """Ranks of the 50k byte-level vocabulary; the JSON form lies beside it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Whole text -> list of ids (no special tokens are added; the mark END_OF_TEXT
    inside a text is its own id, as in ``tokenizers``)."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.json = vocabulary.removesuffix(".tiktoken") + ".json"
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={END_OF_TEXT: END_OF_TEXT_ID})
        self.plain = None

    def __call__(self, text: str) -> list[int]:
        try:
            return self.encoding.encode(text, allowed_special="all")
        except ValueError:  # its pattern engine has no stack for about a million blanks in a row
            if self.plain is None:
                from tokenizers import Tokenizer

                self.plain = Tokenizer.from_file(self.json)
            return self.plain.encode(text, add_special_tokens=False).ids
