"""Where the public tokenizer files lie; a parameter, never a copy."""

from __future__ import annotations

import os

#: Folder of the public vocabulary files; override with PLINTH_TOKENIZERS.
FOLDER = os.environ.get("PLINTH_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary(folder: str | None = None, name: str = VOCABULARY) -> str:
    return os.path.join(folder or FOLDER, name)


def pattern() -> str:
    """The pre-tokenisation pattern that belongs to the byte-level vocabularies."""
    import public_tokenizers

    return public_tokenizers.PATTERN
