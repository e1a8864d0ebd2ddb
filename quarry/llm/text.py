"""Word and id helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the white space of the operators' contracts, as a character class body.
SPACE = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def without_space(text: Column) -> Column:
    """The text with every white-space character deleted; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]", "")


def names_apart(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose first argument may have columns named like its own inner ones, which begin with ``__``.

    Such columns have other names meanwhile and come out as they came in. Those that the call names are left to the operator.
    """

    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        named = {x for x in (*args, *kwargs.values()) if isinstance(x, str)}
        odd = [c for c in docs.columns if c.startswith("__") and c not in named]
        if not odd:
            return operator(docs, *args, **kwargs)
        free = "kept"
        while any(c.startswith(free) for c in docs.columns):
            free += "_"
        aside = {c: f"{free}{k}" for k, c in enumerate(odd)}
        back = {v: k for k, v in aside.items()}
        out = operator(docs.toDF(*(aside.get(c, c) for c in docs.columns)), *args, **kwargs)
        return out.toDF(*(back.get(c, c) for c in out.columns))

    return run


class TokenEncoder:
    """Byte-level BPE. A ``.json`` file is read by tokenizers, a ``.tiktoken`` file by tiktoken; ids agree for the same vocabulary.

    A ``.tiktoken`` file holds no special tokens, so those of a ``.json`` file of the same name beside it are added: their strings
    in a text become their ids, as tokenizers has it.
    """

    def __init__(self, path: str):
        self.path = path
        self.special: dict[str, int] = {}
        if path.endswith(".tiktoken"):
            import base64
            import json
            from pathlib import Path

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}
            named = Path(path).with_suffix(".json")
            if named.exists():
                self.special = {token["content"]: token["id"] for token in json.loads(named.read_text())["added_tokens"] if token["special"]}
            encoding = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
            self.encode = lambda texts: [encoding.encode_to_numpy(text, allowed_special="all") for text in texts]
            self.bytes_of = {rank: word for word, rank in ranks.items()}
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self.special = {token.content: i for i, token in tokenizer.get_added_tokens_decoder().items() if token.special}
            self.encode = lambda texts: [np.array(e.ids, dtype=np.uint32) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            stand_in = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
            self.bytes_of = {i: bytes(stand_in[c] for c in w) for w, i in tokenizer.get_vocab().items() if w not in self.special and all(c in stand_in for c in w)}
        self.size = max([*self.bytes_of, *self.special.values()]) + 1

    def sentence_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Per id: whether it ends a sentence if white space follows (1) or always (2), as special tokens do; whether it starts with white space."""
        ends, starts = np.zeros(self.size, np.uint8), np.zeros(self.size, bool)
        for i, word in self.bytes_of.items():
            shown = word.decode("utf-8", "replace")
            ends[i] = 2 if "\n" in shown or shown.endswith(("。", "！", "？")) else 1 if shown.rstrip("\"')]}").endswith((".", "!", "?")) else 0
            starts[i] = shown[:1].isspace()
        ends[list(self.special.values())] = 2
        return ends, starts


@lru_cache(maxsize=2)
def token_encoder(path: str) -> TokenEncoder:
    """One encoder for each file and Python worker."""
    return TokenEncoder(path)
